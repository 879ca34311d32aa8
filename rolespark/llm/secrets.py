"""Secret scans with built-in functions only: three fixed patterns and sliding-window entropy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolespark.llm.common import let

# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run is matched whole, so the length can stand in the pattern
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 12

#: Strings that entropy may flag, and what the window must reach for each class of characters (bits a character).
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.6, "base64": 3.7}
#: Candidates that match one of these are no secrets: UUIDs, plain numbers, dates and times, placeholders, paths of words.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=/+-]+$",
    r"(?i)example|placeholder|changeme|xxxx|your[_-]",
    r"^[/]?[A-Za-z]+([/_-][A-Za-z]+)*([/_-][0-9]+)?$",
)

_SPAN = "array<struct<start:int,kind:int,end:int,value:string,byte:int>>"
_FOUND = "array<struct<start:int,end:int,value:string,byte:int>>"
#: Values of one block of a running sum.
BLOCK = 32


def running(values: Column, op: Callable[[Column, Column], Column], zero: int, levels: int = 3) -> Column:
    """Running results of an associative op over an array of ints. To append to an array copies it, so values are taken in
    blocks: the running results of each, those of the blocks' last values by the same means, and both put together. Time is
    in proportion to the array (the last level has one value in 32,768)."""

    def appended(v: Column) -> Column:
        start = F.struct(F.lit(zero).alias("last"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct(op(a["last"], x).alias("last"), F.concat(a["out"], F.array(op(a["last"], x))).alias("out"))
        return F.aggregate(v, start, step, lambda a: a["out"])

    def joined(blocks: Column) -> Column:
        before = running(F.transform(blocks, lambda x: F.element_at(x, -1)), op, zero, levels - 1)
        earlier = lambda b, i: F.coalesce(F.get(b, i - 1), F.lit(zero))
        return let(before, lambda b: F.flatten(F.transform(blocks, lambda x, i: F.transform(x, lambda y: op(earlier(b, i), y)))))

    if levels == 0:
        return appended(values)
    places = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    cut = lambda v: F.transform(places(v), lambda k: appended(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
    return let(values, lambda v: F.when(F.size(v) <= BLOCK, appended(v)).otherwise(let(cut(v), joined)))


def _add(x: Column, y: Column) -> Column:
    return x + y


def located(text: Column, pattern: str) -> Column:
    """Matches of pattern, left to right and non-overlapping, as (start, end, value, byte) in code points, byte being where
    the match starts in UTF-8. The parts between the matches come from split, so places are running sums of lengths."""

    def summed(found: Column, between: Column) -> Column:
        pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), (F.length(b) + F.length(m)).alias("points"), (F.octet_length(b) + F.octet_length(m)).alias("bytes")))

        def placed(p: Column) -> Column:
            ends, bytes_ = running(F.transform(p, lambda x: x["points"]), _add, 0), running(F.transform(p, lambda x: x["bytes"]), _add, 0)
            return F.zip_with(
                F.zip_with(p, ends, lambda x, e: F.struct(x["m"].alias("value"), e.alias("end"))),
                bytes_,
                lambda x, b: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value"), (b - F.octet_length(x["value"])).alias("byte")),
            )

        return let(pairs, placed)

    both = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda b: summed(m, b)))
    return F.when(text.rlike(pattern), both).otherwise(F.array().cast(_FOUND))


def _entropy(value: Column) -> Column:
    """Largest Shannon entropy of a window of WINDOW characters. The sum of c*log2(c) over the window's characters is kept:
    each step takes one character away and adds one, and only those two characters' counts, which come from the window,
    change it."""
    codes = F.transform(F.split(value, ""), F.ascii)

    def bits(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def slide(codes: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0.0).alias("best"))

        def step(a: Column, code: Column) -> Column:
            window = F.slice(codes, F.greatest(a["i"] - WINDOW, F.lit(0)) + 1, F.least(a["i"], F.lit(WINDOW)))
            gone = F.get(codes, a["i"] - WINDOW)

            def counted(w: Column) -> Column:
                times = lambda x: F.size(F.filter(w, lambda y: y == x))
                return F.struct(times(gone).alias("out"), (times(code) - F.when(gone.eqNullSafe(code), 1).otherwise(0)).alias("in"))

            def moved(c: Column) -> Column:
                total = a["sum"] - F.when(gone.isNull(), F.lit(0.0)).otherwise(bits(c["out"]) - bits(c["out"] - 1)) - bits(c["in"]) + bits(c["in"] + 1)
                entropy = F.log2(F.lit(float(WINDOW))) - total / WINDOW
                best = F.when(a["i"] + 1 >= WINDOW, F.greatest(a["best"], entropy)).otherwise(a["best"])
                return F.struct(total.alias("sum"), (a["i"] + 1).alias("i"), best.alias("best"))

            return let(let(window, counted), moved)

        return F.aggregate(codes, start, step, lambda a: a["best"])

    return let(codes, slide)


def _overlaps(x: Column, spans: Column) -> Column:
    """Whether x overlaps one of the spans, which are in order and do not overlap one another: bisection for the first one
    that ends after x starts."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halved(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        after = F.coalesce(F.get(spans, middle)["end"] > x["start"], F.lit(True))
        open_ = a["low"] < a["high"]
        return F.struct(F.when(open_ & ~after, middle + 1).otherwise(a["low"]).alias("low"), F.when(open_ & after, middle).otherwise(a["high"]).alias("high"))

    first = F.aggregate(steps, start, halved, lambda a: F.get(spans, a["low"])["start"])
    return F.coalesce(first < x["end"], F.lit(False))


def _is_secret(value: Column) -> Column:
    allowed = value.rlike("|".join(f"(?:{p})" for p in ALLOW if not p.startswith("(?i)")) )
    for p in ALLOW:
        if p.startswith("(?i)"):
            allowed = allowed | value.rlike(p)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    least = F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(THRESHOLDS["hex"])).when(value.rlike("^[0-9A-Za-z]+$"), F.lit(THRESHOLDS["alphanumeric"])).otherwise(F.lit(THRESHOLDS["base64"]))
    return F.when(mixed & ~allowed, _entropy(value) >= least).otherwise(F.lit(False))


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Adds column out: array of (start, kind, end, value, byte) sorted by start, then kind in the order of KINDS; start and
    end count code points, end is exclusive, byte is the start in UTF-8 bytes. Entropy spans that touch a pattern's span are
    left out. Null or empty text: empty array. Rows are scanned each by itself, in time in proportion to their text;
    an existing column named out is replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def tagged(found: Column, kind: str) -> Column:
        own = lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["value"].alias("value"), x["byte"].alias("byte"))
        return F.transform(found, own)

    # a key's or hex run's characters are all of a candidate's class, so it lies in the candidate or outside of it
    free = F.filter(located(text, CANDIDATE), lambda x: ~x["value"].rlike(f"{ACCESS}|{HEX}"))
    assign = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    fresh = let(
        assign,
        lambda a: F.concat(
            tagged(a, "assign"),
            tagged(located(text, ACCESS), "access"),
            tagged(located(text, HEX), "hex"),
            tagged(F.filter(free, lambda x: ~_overlaps(x, a) & _is_secret(x["value"])), "entropy"),
        ),
    )
    return docs.withColumn(out, F.sort_array(fresh).cast(_SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by <kind>; of spans that overlap, the first stays and the later part goes with it. The
    parts between are cut by byte, so time is in proportion to the text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    data = text.cast("binary")
    after = lambda x: x["byte"] + F.octet_length(x["value"])

    def parts(ends: Column) -> Column:
        """For each span what stands before it and its mark, nothing for one that begins inside an earlier one."""

        def part(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(ends, i - 1), F.lit(0))
            kept = F.substring(data, at + 1, F.greatest(x["byte"] - at, F.lit(0))).cast("string")
            return F.when(x["byte"] < at, F.lit("")).otherwise(F.concat(kept, F.lit("<"), F.get(names, x["kind"]), F.lit(">")))

        rest = F.substring(data, F.element_at(ends, -1) + 1, F.octet_length(text)).cast("string")
        return F.concat(F.array_join(F.transform(spans, part), ""), rest)

    redacted = let(running(F.transform(spans, after), lambda x, y: F.greatest(x, y), 0), parts)
    return F.when(F.size(spans) > 0, redacted).otherwise(text)


def digest(found: DataFrame, spans: str = "secrets") -> DataFrame:
    """The contract's columns from scan's output."""
    col = F.col(spans)

    def count(kind: str) -> Column:
        return F.size(F.filter(col, lambda x: x["kind"] == KINDS.index(kind))).cast("long")

    base = F.filter(col, lambda x: x["kind"] < KINDS.index("entropy"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(col).alias("spans"),
    )
