"""Column functions: hashing into pools, canonical texts, geometry, probabilities."""
from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_sha256(*parts: Column | str | int, sep: str = "|") -> Column:
    """SHA-256 (hex) of the parts' text, joined."""
    return F.sha2(F.concat_ws(sep, *(F.lit(p) if isinstance(p, int) else p for p in parts)), 256)


def hex_boundaries(weights: Sequence[float]) -> list[str]:
    """For each cumulative share but the last, the least 256-bit hash at or beyond it, as 64 hex digits.

    Hex digests compare as text in the order of their numbers, so a digest's share of the unit interval
    never has to be computed in floating point.
    """
    exact = [Fraction(str(w)) for w in weights]
    total, run, out = sum(exact), Fraction(0), []
    for w in exact[:-1]:
        run += w
        out.append(f"{-(-run * 2**256 // total):064x}")
    return out


def hash_pool(digest: Column, names: Sequence[str], weights: Sequence[float]) -> Column:
    """The pool whose share of the unit interval a digest falls into."""
    out = None
    for name, bound in zip(names, hex_boundaries(weights), strict=False):
        out = F.when(digest < bound, name) if out is None else out.when(digest < bound, name)
    return F.lit(names[0]) if out is None else out.otherwise(names[-1])


def hash_modulo(digest: Column, n: int) -> Column:
    """The first 16 hex digits as an unsigned number, modulo n."""
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("long")


def group_identifier(*parts: Column | str) -> Column:
    """'grp_' and 24 hex digits of the hash of the parts as a JSON array of strings."""
    return F.concat(F.lit("grp_"), F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 24))


def signature(values: Column | str, sep: str = "|") -> Column:
    """Aggregate: the distinct values in order, joined."""
    return F.concat_ws(sep, F.array_sort(F.collect_set(values)))


def normalised_name(c: Column | str) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9_]+", "_"), F.lit("_")))


def safe_relative_path(c: Column) -> Column:
    """Whether a path is relative, non-empty, without backslashes, drive letters and parent steps."""
    return (F.trim(c) != "") & ~c.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_start(epoch: Column, seconds: int) -> Column:
    """The start of the block of `seconds` that an epoch second falls into."""
    return (F.floor(epoch / seconds) * seconds).cast("long")


def logistic(x: Column, bound: float = 40.0) -> Column:
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))))


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where both are empty."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[k + 2], b[k + 2]) - F.greatest(a[k], b[k]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    both = side(0) * side(1)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def corner_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Normalised centre, width and height to absolute corners."""
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]


def centre_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Absolute corners to normalised centre, width and height."""
    return [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height]


def on_grid(x: Column, grid: Sequence[float]) -> Column:
    """Whether a value is one of a grid's, within the tolerance of float comparison."""
    return F.exists(F.array(*map(F.lit, grid)), lambda g: F.abs(g - x) <= 1e-8 + 1e-5 * F.abs(g))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero: what two engines that add in different orders agree on."""
    return F.round(x, digits) + F.lit(0.0)


def gamma(pixels: Column, g: float) -> Column:
    """A gamma curve over an array of bytes (0 to 255)."""
    return F.transform(pixels, lambda p: F.round(255 * F.pow(p / 255.0, F.lit(g))).cast("int"))


def mapped(x: Column, values: dict) -> Column:
    """The value that `values` has for x; one that it has not is an error, null stays null."""
    table = F.create_map(*(F.lit(v) for kv in values.items() for v in kv))
    return F.when(x.isNull(), F.lit(None)).when(F.map_contains_key(table, F.coalesce(x, F.lit(next(iter(values))))), F.element_at(table, x)).otherwise(F.raise_error(F.concat(F.lit("no value for "), x.cast("string"))))


def zoned_time(text: Column) -> Column:
    """An ISO time with a zone (Z or an offset) as an instant; null for any other text."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def label_signature(label: Column, paths: Sequence[str]) -> Column:
    """SHA-256 of a struct as JSON without its path fields."""
    return F.sha2(F.to_json(label.dropFields(*paths)), 256)


def semantic_signature(concepts: Column, present: Column, verified: Column) -> Column:
    """SHA-256 of the distinct concepts in order, with whether any is present and whether negatives are verified."""
    return F.sha2(F.to_json(F.struct(F.array_sort(F.array_distinct(concepts)).alias("concepts"), present.alias("present"), verified.alias("verified"))), 256)


def distinct_filled(x: Column | str) -> Column:
    """Aggregate: distinct values, blank ones and nulls left out."""
    return F.countDistinct(F.when(F.trim(x) != "", F.trim(x)))



# JSON's short escapes, by UTF-16 unit.
JSON_ESCAPES = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "000C": "\\f", "000A": "\\n", "000D": "\\r", "0009": "\\t"}


def json_text(text: Column) -> Column:
    """A text as a JSON string of ASCII characters alone; all else is \\u and four lower-case hex digits of each UTF-16 unit. Linear in the text."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), 1)
    short = F.create_map(*(F.lit(x) for pair in JSON_ESCAPES.items() for x in pair))
    plain = lambda u: u.between("0020", "007E")
    each = lambda u: F.coalesce(F.try_element_at(short, u), F.when(plain(u), F.unhex(F.substring(u, 3, 2)).cast("string")), F.concat(F.lit("\\u"), F.lower(u)))
    return F.concat(F.lit('"'), F.array_join(F.transform(units, each), ""), F.lit('"'))


def canonical_json(fields: dict[str, Column], texts: Sequence[str] = (), lists: Sequence[str] = ()) -> Column:
    """A compact JSON object in ASCII with its names in order: `texts` are strings, `lists` arrays of strings, others integers or booleans. Null is null."""

    def value(name: str) -> Column:
        c = fields[name]
        if name in texts:
            shown = json_text(c)
        elif name in lists:
            shown = F.concat(F.lit("["), F.array_join(F.transform(c, json_text), ","), F.lit("]"))
        else:
            shown = c.cast("string")
        return F.coalesce(shown, F.lit("null"))

    parts = [F.concat(json_text(F.lit(name)), F.lit(":"), value(name)) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def file_number(stem: Column) -> Column:
    """The place of a file's number among others, as (namespace, major, minor): of `123` (0, 123, 0), of `p12-3` (1, 12, 3); null for other stems."""
    part = lambda pattern, group: F.regexp_extract(stem, pattern, group).try_cast("long")
    place = lambda a, b, c: F.struct(F.lit(a).alias("namespace"), b.alias("major"), c.alias("minor"))
    plain, paged = "^([0-9]+)$", "^[pP]([0-9]+)-([0-9]+)$"
    number = F.when(stem.rlike(plain), place(0, part(plain, 1), F.lit(0).cast("long"))).when(stem.rlike(paged), place(1, part(paged, 1), part(paged, 2)))
    return F.when(number["major"].isNotNull() & number["minor"].isNotNull(), number)
