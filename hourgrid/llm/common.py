"""Small helpers shared by the text operators."""

import ctypes
import ctypes.util
import gc

import pyarrow as pa
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_bytes(value):
    """UTF-8 of a text; null counts as empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def map_rows(df, rows, schema, slice_rows=512):
    """Apply ``rows`` to Arrow record batches and return a DataFrame of ``schema``.

    ``rows`` gets a dict of column lists and returns a dict of column lists. A
    batch is handed over in slices, so that a task holds few texts at a time.
    """
    target = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                out = rows(batch.slice(start, slice_rows).to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_pydict(
                        {f.name: pa.array(out[f.name], f.type) for f in target}, schema=target
                    )

    return df.mapInArrow(run, schema)


def arrow_schema(spark, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def nested(docs):
    """All columns in ``row`` beside doc_id and text, so that no new name meets an old one."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text")


class Worker:
    """What a Python worker holds for the operator it works for now.

    A worker lives through many stages. Encoders, lexicons and remembered results
    belong to an owner; those of all others go as soon as another one is at work.
    """

    owner = None
    made = {}
    remembered = []  # weak references to dictionaries with an ``owner``


def held(owner, key, build):
    """The result of ``build()``, made once per worker while ``owner`` is at work."""
    take_over(owner)
    if key not in Worker.made:
        Worker.made[key] = build()
    return Worker.made[key]


def take_over(owner):
    if Worker.owner == owner:
        return
    Worker.owner, Worker.made = owner, {}
    live = [(ref, ref()) for ref in Worker.remembered]
    Worker.remembered = [ref for ref, one in live if one is not None]
    for _, one in live:
        if one is not None and one.owner != owner:
            one.forget()
    del live
    gc.collect()
    # Freed memory goes back to the system, not only to this process.
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(ctypes.CDLL(libc), "malloc_trim"):
        ctypes.CDLL(libc).malloc_trim(0)
