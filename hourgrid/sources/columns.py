"""Resolve file headers to the price schema and coerce text to values."""

from pyspark.sql import functions as F

from hourgrid.schemas import PRICE, PRICE_CEILING, PRICE_FLOOR

# Header fragments a generic price file must show.
REQUIRED_PATTERNS = ("INTERVALSTARTTIME", "NODE", "MW")


def _has(*parts):
    return lambda name: all(part in name for part in parts)


def _any(*parts):
    return lambda name: any(part in name for part in parts)


def _is(*names):
    return lambda name: name in names


# First matching rule wins.
HEADER_RULES = (
    (_has("INTERVALSTARTTIME", "GMT"), "INTERVALSTARTTIME_GMT"),
    (_is("NODE"), "NODE"),
    (_has("NODE", "ID"), "NODE_ID"),
    (lambda name: name == "MW" or "PRICE" in name, "MW"),
    (_any("MCC", "CONGESTION"), "MCC"),
    (_any("MLC", "LOSS"), "MLC"),
    (_any("POS"), "POS"),
    (_is("OPR_HR"), "opr_hr"),
    (_is("OPR_DT"), "opr_dt"),
)


def resolve_price_columns(header):
    """Positions of the strict price layout, by name; missing ones are absent.

    The node is the first column called NODE or containing PNODE.
    """
    names = [name.upper() for name in header]
    wanted = {name: _is(name.upper()) for name in ("opr_dt", "opr_hr", "mw")}
    wanted["node"] = lambda name: name == "NODE" or "PNODE" in name
    wanted.update({name: _is(name.upper()) for name in ("mcc", "mlc", "pos")})
    found = {}
    for target, rule in wanted.items():
        hits = [i for i, name in enumerate(names) if rule(name)]
        if hits:
            found[target] = hits[0]
    return found


STRICT_COLUMNS = ("node", "mw", "opr_dt", "opr_hr")


def validate_format(header):
    """Whether a header shows every pattern of a generic price file."""
    names = [name.upper() for name in header]
    return all(any(p in name for name in names) for p in REQUIRED_PATTERNS)


def to_price(column):
    """Text to price; anything that is not a finite number gives NULL."""
    return F.trim(column.cast("string")).try_cast(PRICE)


def to_day(column):
    """``yyyy-M-d`` text to date, NULL otherwise."""
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def to_hour(column):
    """Whole-number text to hour, NULL otherwise."""
    return F.trim(column.cast("string")).try_cast("int")


def typed_prices(raw):
    """Strict text columns to the price schema; unusable rows are dropped."""
    optional = [name for name in ("mcc", "mlc", "pos") if name in raw.columns]
    kept = [name for name in ("source_file", "row_id") if name in raw.columns]
    node = F.trim("node")
    return (
        raw.select(
            F.when(node != "", node).alias("node"),
            to_price(F.col("mw")).alias("mw"),
            to_day(F.col("opr_dt")).alias("opr_dt"),
            to_hour(F.col("opr_hr")).alias("opr_hr"),
            *[to_price(F.col(name)).alias(name) for name in optional],
            *kept,
        )
        .dropna(subset=list(STRICT_COLUMNS))
    )


def standardize_columns(df):
    """Rename header variants to the canonical names, keep the first of each.

    With both a NODE and a NODE_ID the latter is dropped; columns no rule knows
    keep their name.
    """
    chosen = {}
    for column in df.columns:
        name = column.upper()
        target = next((to for rule, to in HEADER_RULES if rule(name)), column)
        chosen.setdefault(target, column)
    if "NODE" in chosen:
        chosen.pop("NODE_ID", None)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in chosen.items()])


def derive_date_hour(df):
    """Fill missing operating date or hour from the GMT stamp.

    The stamp is a fallback only: it is offset from the wall clock, so existing
    operating columns always win.
    """
    missing = [name for name in ("opr_dt", "opr_hr") if name not in df.columns]
    if not missing or "INTERVALSTARTTIME_GMT" not in df.columns:
        return df
    stamp = F.col("INTERVALSTARTTIME_GMT").cast("string").try_cast("timestamp_ntz")
    parts = {"opr_dt": F.to_date(stamp), "opr_hr": F.hour(stamp)}
    for name in missing:
        df = df.withColumn(name, parts[name])
    return df.withColumn("DAY_OF_WEEK", F.date_format(stamp, "EEEE"))


def clean_numeric(df):
    """Coerce the price columns; a price outside the plausible band becomes NULL."""
    for name in ("MW", "MCC", "MLC", "POS"):
        if name in df.columns:
            df = df.withColumn(name, to_price(F.col(name)))
    if "MW" in df.columns:
        plausible = F.col("MW").between(PRICE_FLOOR, PRICE_CEILING)
        df = df.withColumn("MW", F.when(plausible, F.col("MW")))
    return df


def typed_standard(df):
    """Operating date and hour of a standardised frame as DATE and INT."""
    for name, convert in (("opr_dt", to_day), ("opr_hr", to_hour)):
        if name in df.columns and dict(df.dtypes)[name] == "string":
            df = df.withColumn(name, convert(F.col(name)))
    return df
