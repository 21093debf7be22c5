"""Table contracts, checked in one pass, and joins with a declared cardinality."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.quantiles import null_safe_join

SHA256 = "^[0-9a-f]{64}$"
# Names of truths, and how such names begin and end.
TRUTH_PREFIXES = ("truth_", "label_", "target_", "test_metric_")
TRUTH_NAMES = (
    "accuracy", "auroc", "event_truth", "f1", "state_truth", "label", "loss", "map50", "map50_95", "metric", "precision", "recall", "target", "test_metric", "test_label", "truth", "ground_truth",
    "future_value", "forecast_label",
)
TRUTH_SUFFIXES = ("_truth", "_label", "_target", "_metric")
# What an ontology's entries may say.
MAPPING_STATUSES = ("compatible", "ignored", "unmapped", "reject")
EVENT_SEMANTICS = ("observable_presence", "annotated_anomaly", "threshold_risk", "not_event_eligible")
NEGATIVE_SEMANTICS = ("exhaustive_verified_absence", "unverified_missing_annotation", "not_applicable")


class ContractError(ValueError):
    """A table breaks its contract; the message names every broken rule and how many rows break it."""


@dataclass(frozen=True)
class TableContract:
    """What a table must hold: columns, a key, values per column, functional dependencies, forbidden names."""

    required: Sequence[str] = ()
    key: Sequence[str] = ()
    not_blank: Sequence[str] = ()
    one_of: dict[str, Sequence[str]] = field(default_factory=dict)
    matches: dict[str, str] = field(default_factory=dict)
    between: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    json_objects: Sequence[str] = ()
    sorted_sets: Sequence[str] = ()
    rules: dict[str, Column] = field(default_factory=dict)
    forbidden: Sequence[str] = ()

    def missing(self, df: DataFrame) -> list[str]:
        """Required columns that are absent and forbidden ones that are present."""
        return [c for c in self.required if c not in df.columns] + [f"forbidden:{c}" for c in df.columns if c in self.forbidden]

    def row_rules(self) -> dict[str, Column]:
        """Each rule as a condition that is true on rows that break it; null breaks a rule, except in ranges."""
        broken = lambda good: ~F.coalesce(good, F.lit(False))
        out = {f"blank:{c}": broken(F.trim(c) != "") for c in self.not_blank}
        out |= {f"enum:{c}": broken(F.col(c).isin(*v)) for c, v in self.one_of.items()}
        out |= {f"regex:{c}": broken(F.col(c).rlike(p)) for c, p in self.matches.items()}
        for c, (low, high) in self.between.items():
            good = F.lit(True)
            if low is not None:
                good = good & (F.col(c) >= low)
            if high is not None:
                good = good & (F.col(c) <= high)
            out[f"range:{c}"] = F.col(c).isNotNull() & broken(good & ~F.isnan(F.col(c).cast("double")))
        out |= {f"json:{c}": broken(F.from_json(c, "map<string,string>").isNotNull()) for c in self.json_objects}
        out |= {f"set:{c}": broken(F.array_sort(F.array_distinct(c)) == F.col(c)) for c in self.sorted_sets}
        return out | {f"rule:{n}": broken(c) for n, c in self.rules.items()}

    def violations(self, df: DataFrame) -> DataFrame:
        """(rule, broken): rows that break each row rule, from one aggregation, and surplus rows of keys.

        An empty table breaks nothing. Missing columns are the caller's to ask for first (`missing`).
        """
        rules = self.row_rules()
        spark = df.sparkSession
        counts = df.agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())))
        pairs = [F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("broken")) for i, n in enumerate(rules)]
        out = counts.select(F.explode(F.array(*pairs)).alias("v")).select("v.*") if pairs else spark.createDataFrame([], "rule string, broken long")
        if self.key:
            surplus = df.groupBy(*self.key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("broken"))
            out = out.unionByName(surplus.select(F.lit("key").alias("rule"), "broken"))
        return out

    def check(self, df: DataFrame) -> DataFrame:
        """`df` itself, or ContractError; what comes to the driver is one row a rule."""
        if absent := self.missing(df):
            raise ContractError(f"columns: {', '.join(absent)}")
        if broken := [(r.rule, r.broken) for r in self.violations(df).where("broken > 0").collect()]:
            raise ContractError(", ".join(f"{rule} ({n} rows)" for rule, n in sorted(broken)))
        return df


def determines(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Groups that have more than one value, null counted as a value: what breaks group -> value."""
    distinct = F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(*group).agg(distinct.alias("values")).where("values > 1")


def surplus_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", cardinality: str = "m:1", complete: bool = False) -> DataFrame:
    """A join whose "one" sides are proved to hold each key once; `complete` also demands a partner for every row.

    The proof is a grouped count a side, which stops the job before the join is used.
    """
    for side, df, one in (("left", left, cardinality[0] == "1"), ("right", right, cardinality[-1] == "1")):
        if one and surplus_keys(df, on).limit(1).collect():
            raise ContractError(f"{cardinality} join: the {side} side repeats a key of {list(on)}")
    if complete and left.join(right.select(*on), list(on), "left_anti").limit(1).collect():
        raise ContractError(f"a row of the left side has no partner on {list(on)}")
    return left.join(right, list(on), how)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, rows): rows of each side that the other lacks, as multisets; both zero for equal tables."""
    one = left.exceptAll(right.select(*left.columns)).agg(F.count("*").alias("rows")).withColumn("side", F.lit("left"))
    other = right.select(*left.columns).exceptAll(left).agg(F.count("*").alias("rows")).withColumn("side", F.lit("right"))
    return one.unionByName(other).select("side", "rows")


def model_features(df: DataFrame, names: Sequence[str], identity: Sequence[str], tokens: Sequence[str] = ("truth", "label", "target", "future")) -> DataFrame:
    """A projection that refuses identity columns and names with a forbidden token in them."""
    bad = [n for n in names if n in identity or set(n.lower().split("_")) & set(tokens)]
    if bad:
        raise ContractError(f"not model features: {', '.join(bad)}")
    return df.select(*names)


def names_of_truth(columns: Sequence[str], names: Sequence[str] = TRUTH_NAMES, prefixes: Sequence[str] = TRUTH_PREFIXES, suffixes: Sequence[str] = TRUTH_SUFFIXES) -> list[str]:
    """The columns that a prediction must not hold, in order: by whole name, by how they begin or by how they end, in any case."""
    return sorted(c for c in columns if c.lower() in names or c.lower().startswith(tuple(prefixes)) or c.lower().endswith(tuple(suffixes)))


def asymmetric_edges(edges: DataFrame, key: Sequence[str], source: str, target: str) -> DataFrame:
    """Self edges, and edges whose reverse is absent: what breaks a symmetric edge table. Repeated edges count once."""
    e = edges.select(*key, source, target).distinct()
    reverse = e.select(*key, F.col(target).alias(source), F.col(source).alias(target))
    lone = e.join(reverse, [*key, source, target], "left_anti").withColumn("fault", F.lit("no_reverse"))
    return lone.unionByName(e.where(F.col(source) == F.col(target)).withColumn("fault", F.lit("self")))


def trace_faults(df: DataFrame, key: Sequence[str], phase: str, counts: dict[str, int], constant: Sequence[str]) -> DataFrame:
    """Measurements whose phases do not have exactly the given numbers of rows, or whose constant columns vary."""
    wrong = [F.count_if(F.col(phase) == p) != n for p, n in counts.items()] + [F.countDistinct(c) > 1 for c in constant]
    bad = wrong[0]
    for w in wrong[1:]:
        bad = bad | w
    return df.groupBy(*key).agg(F.count("*").alias("rows"), bad.alias("bad")).where("bad").drop("bad")


def ontology_contract() -> TableContract:
    """Entries that map a dataset's labels to concepts: compatible ones name concept, policy and evidence; F1 that confirms needs verified negatives."""
    compatible = F.coalesce(F.col("mapping_status") == "compatible", F.lit(False))
    filled = lambda c: ~compatible | (F.trim(c) != "")
    verified = F.col("negative_semantics") == "exhaustive_verified_absence"
    return TableContract(
        required=("dataset_id", "source_label", "canonical_concept_id", "mapping_status", "event_semantics", "negative_semantics", "allowed_tasks", "annotation_policy", "evidence_reference"),
        key=("dataset_id", "source_label"),
        one_of={"mapping_status": MAPPING_STATUSES, "event_semantics": EVENT_SEMANTICS, "negative_semantics": NEGATIVE_SEMANTICS},
        rules={"tasks": F.col("allowed_tasks").isNotNull(), "concept": filled("canonical_concept_id"), "policy": filled("annotation_policy"), "evidence": filled("evidence_reference"), "verified negatives": ~F.array_contains("allowed_tasks", "confirmatory_f1") | verified},
    )


# What two tables can differ in.
DIFFERENCES = ("only_left", "only_right", "repeated_left", "repeated_right", "null", "value")


def table_differences(left: DataFrame, right: DataFrame, key: Sequence[str], tolerance: dict[str, float] | None = None, first: int = 3) -> DataFrame:
    """(kind, column, rows, first): how two tables that should be one differ, by kind of difference and column.

    Rows meet by `key` in one join, nulls in it being equal. Numbers of the columns in `tolerance` may differ by
    that much; all else must be equal, NaN to NaN. A key on one side only, or with several rows on a side,
    counts once under no column, and repeated keys are compared no further. `first` has the first keys of
    each kind, as text, in the order of that text. Columns that only one table has are an error.
    """
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    near, columns = tolerance or {}, [c for c in left.columns if c not in key]
    side = lambda df, s: df.groupBy(*(F.col(k).alias(f"_{s}_{k}") for k in key)).agg(F.count("*").alias(f"_{s}_n"), *(F.first(c).alias(f"_{s}{i}") for i, c in enumerate(columns)))
    met = side(left, "l").join(side(right, "r"), reduce(lambda a, b: a & b, (F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}")) for k in key)), "full")
    both = F.col("_l_n").isNotNull() & F.col("_r_n").isNotNull()
    single = both & (F.col("_l_n") == 1) & (F.col("_r_n") == 1)
    found = [
        (F.col("_r_n").isNull(), "only_left", None), (F.col("_l_n").isNull(), "only_right", None),
        (both & (F.col("_l_n") > 1), "repeated_left", None), (both & (F.col("_r_n") > 1), "repeated_right", None),
    ]
    for i, c in enumerate(columns):
        a, b = F.col(f"_l{i}"), F.col(f"_r{i}")
        found.append((single & (a.isNull() != b.isNull()), "null", c))
        unequal = ~((F.abs(a - b) <= near[c]) | a.eqNullSafe(b)) if c in near else ~a.eqNullSafe(b)
        found.append((single & a.isNotNull() & b.isNotNull() & unequal, "value", c))
    marks = F.filter(F.array(*(F.when(ok, F.struct(F.lit(kind).alias("kind"), F.lit(c).cast("string").alias("column"))) for ok, kind, c in found)), lambda x: x.isNotNull())
    name = F.concat_ws("|", *(F.coalesce(F.col(f"_l_{k}"), F.col(f"_r_{k}")).cast("string") for k in key))
    long = met.select(name.alias("_key"), F.explode(marks).alias("m")).select("_key", "m.*").withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(64)))
    early = long
    for by in (["kind", "column", "_salt"], ["kind", "column"]):  # the first of every salt, then of those
        early = early.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_key"))).where(F.col("_n") <= first)
    listed = early.groupBy("kind", "column").agg(F.array_join(F.sort_array(F.collect_list("_key")), ",").alias("first"))
    counts = long.groupBy("kind", "column").agg(F.count("*").alias("rows"))
    return null_safe_join(counts, listed, ["kind", "column"]).select("kind", "column", "rows", "first")


def nested_violations(df: DataFrame, sorted_unique: Sequence[str] = (), map_keys: dict[str, Sequence[str]] | None = None, elements: dict[str, tuple[str, Callable[[Column], Column]]] | None = None, rules: dict[str, Column] | None = None) -> DataFrame:
    """(rule, broken, elements): rules inside nested columns, counted in one pass: rows that break each, and elements that do.

    `sorted_unique`: arrays of strings whose items are not blank and rise strictly. `map_keys`: maps with
    exactly these keys. `elements`: {rule: (array or map column, condition on an element or a map's
    value)}; a null condition is broken. `rules`: conditions over a row's columns, null likewise. A null
    array or map breaks the rules on it, with no element.
    """
    parts: dict[str, tuple[Column, Column]] = {}
    for c in sorted_unique:
        a = F.col(c)
        blank = F.size(F.filter(a, lambda x: x.isNull() | (F.trim(x) == "")))
        falls = F.size(F.filter(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), lambda x, y: y.isNotNull() & (y <= x)), lambda x: x))
        parts[f"blank:{c}"] = (a.isNull() | (blank > 0), blank)
        parts[f"sorted:{c}"] = (a.isNull() | (falls > 0), falls)
    for c, keys in (map_keys or {}).items():
        have, want = F.map_keys(c), F.array(*map(F.lit, keys))
        odd = F.size(F.array_except(have, want)) + F.size(F.array_except(want, have))
        parts[f"keys:{c}"] = (F.col(c).isNull() | (odd > 0), odd)
    for rule, (c, condition) in (elements or {}).items():
        values = F.map_values(c) if df.schema[c].dataType.typeName() == "map" else F.col(c)
        bad = F.size(values) - F.size(F.filter(values, condition))  # a filter keeps what is true
        parts[f"element:{rule}"] = (F.col(c).isNull() | (bad > 0), bad)
    for rule, condition in (rules or {}).items():
        bad = ~F.coalesce(condition, F.lit(False))
        parts[f"rule:{rule}"] = (bad, bad.cast("int"))
    sums = [F.struct(F.lit(r).alias("rule"), F.count_if(row).alias("broken"), F.coalesce(F.sum(F.greatest(n, F.lit(0)).cast("long")), F.lit(0)).alias("elements")).alias(f"_{i}") for i, (r, (row, n)) in enumerate(parts.items())]
    one = df.agg(*sums)
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")


def fusion_eligibility(df: DataFrame, pools: Sequence[str], floor: int | None = None) -> DataFrame:
    """`nested_violations` of a table that says which concepts may be fused.

    Columns: concept_id, fusion_primary_eligible, graph_primary_eligible, three hashes, eligible_branch_types
    (array) and their count, independent_multibranch_positive_group_count, multibranch_event_count_by_pool
    (a map of all `pools`), exclusion_reason; model_outcomes_used may be there and must be false.
    """
    eligible, types, reason = F.col("fusion_primary_eligible"), F.col("eligible_branch_types"), F.col("exclusion_reason")
    sha = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    groups = F.col("independent_multibranch_positive_group_count")
    rules = {
        "graph_needs_fusion": ~F.col("graph_primary_eligible") | eligible, **{c: sha(c) for c in ("episode_skeleton_candidate_hash", "ontology_lock_hash", "split_manifest_hash")},
        "type_count": F.col("eligible_branch_type_count") == F.size(types), "group_count": groups >= 0, "two_types": ~eligible | (F.size(types) >= 2),
        "no_reason": ~eligible | reason.isNull(), "reason": eligible | F.coalesce(F.trim(reason) != "", F.lit(False)),
    }
    if floor is not None:
        rules["floor"] = ~eligible | (groups >= floor)
    if "model_outcomes_used" in df.columns:
        rules["no_outcomes"] = ~F.col("model_outcomes_used")
    once = df.groupBy("concept_id").agg(F.count("*").alias("n")).agg(F.lit("key:concept_id").alias("rule"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("broken"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("elements"))
    found = nested_violations(df, ["eligible_branch_types"], {"multibranch_event_count_by_pool": pools}, {"event_count": ("multibranch_event_count_by_pool", lambda x: x >= 0)}, rules)
    return found.unionByName(once)
