"""File-system calls that work on any storage Spark can reach."""


def _file_system(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def list_folders(spark, path):
    """Names of the data folders directly below ``path``."""
    target, files = _file_system(spark, path)
    if not files.exists(target):
        return []
    names = [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()]
    return sorted(name for name in names if name[0] not in "._")


def exists(spark, path):
    target, files = _file_system(spark, path)
    return files.exists(target)


def drop_folder(spark, path):
    target, files = _file_system(spark, path)
    return files.delete(target, True)


def move_folder(spark, source, target):
    """Rename a folder; its new parent is made and an old target must be gone."""
    old, files = _file_system(spark, source)
    new = spark._jvm.org.apache.hadoop.fs.Path(target)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def list_hidden(spark, path):
    """Names of all folders directly below ``path``, with those of jobs."""
    target, files = _file_system(spark, path)
    if not files.exists(target):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(target) if s.isDirectory())
