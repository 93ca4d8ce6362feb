"""Row stages: ordered rules, rate lookups, effective dates, and analytics of how rules cover the data."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import case_value
from .effective import effective_problems, join_in_force, overlapping  # noqa: F401  also reached from here

UNMAPPED = "(unmapped)"
WORD_BITS = 62  # conditions whose results share a long
MANY_RULES = 100  # from here on a chain of branches outgrows one generated method; rules are matched as an array instead


@dataclass(frozen=True)
class Rule:
    id: str
    when: str  # a SQL condition
    emit: str

    @property
    def condition(self) -> Column:
        return F.coalesce(F.expr(self.when), F.lit(False))


Step = Callable[[DataFrame], DataFrame]


def row_stage(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Derived columns one after another; each may read the ones before."""
    return reduce(lambda d, step: d.transform(step), steps, df)


def _first(rules: Sequence[Rule], value: Callable[[Rule], str]) -> Column:
    if len(rules) < MANY_RULES:
        return case_value([(r.condition, F.lit(value(r))) for r in rules])
    place = F.array_position(F.array(*[r.condition for r in rules]), F.lit(True))
    return F.try_element_at(F.array(*[F.lit(value(r)) for r in rules]), F.when(place > 0, place).cast("int"))


def classify(df: DataFrame, rules: Sequence[Rule], column: str, attribution: str | None = None) -> DataFrame:
    """What the first matching rule emits; null if none matches, never a default. attribution: also the rule's id, under that name."""
    added = {column: _first(rules, lambda r: r.emit)}
    if attribution:
        added[attribution] = _first(rules, lambda r: r.id)
    return df.withColumns(added)


def atoms_of(when: str) -> list[str]:
    """The conditions that a condition joins by `and` outside of brackets and quotes; one with `or`, `between` or `case` there is taken whole."""
    depth, parts, plain = 0, [""], ""
    for word in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\w+|\s+|.", when, re.DOTALL):
        depth += (word == "(") - (word == ")")
        if depth == 0 and word.lower() == "and":
            parts.append("")
            continue
        parts[-1] += word
        if depth == 0 and word[0] not in "'\"`":
            plain += f" {word.lower()} "
    if depth or re.search(r"\b(or|between|case)\b", plain):
        return [when.strip()]
    return [p.strip() for p in parts]


def matches(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """_hits (ids of all rules that match, in order) and n, the rows that those match.

    Each distinct condition that rules are made of is worked out once a row, as one bit; rows are counted by their bits, and
    only the distinct patterns meet the rules, which are masks of bits."""
    atoms = list(dict.fromkeys(a for r in rules for a in atoms_of(r.when)))
    bit = {a: divmod(i, WORD_BITS) for i, a in enumerate(atoms)}
    words = len(atoms) // WORD_BITS + 1
    mine = lambda j: [F.when(F.expr(a), F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for a, (w, i) in bit.items() if w == j]
    columns = [reduce(lambda x, y: x.bitwiseOR(y), mine(j), F.lit(0).cast("long")).alias(f"_w{j}") for j in range(words)]
    counted = df.select(*columns).groupBy(*[f"_w{j}" for j in range(words)]).agg(F.count("*").alias("n"))

    def masks(r: Rule) -> list[int]:
        own = [bit[a] for a in atoms_of(r.when)]
        return [sum(1 << i for i in {i for w, i in own if w == j}) for j in range(words)]

    table = [(i, r.id, masks(r)) for i, r in enumerate(rules)]
    spark = df.sparkSession
    one = spark.createDataFrame(table, "ord int, id string, masks array<long>")
    listed = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "masks"))), lambda r: F.struct(r["id"], r["masks"])).alias("_rules"))
    has = lambda r: reduce(lambda x, y: x & y, [F.col(f"_w{j}").bitwiseAND(r["masks"][j]) == r["masks"][j] for j in range(words)])
    hits = F.transform(F.filter("_rules", has), lambda r: r["id"])
    return counted.crossJoin(F.broadcast(listed)).select(hits.alias("_hits"), "n")  # one row of rules


def rules_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.sparkSession.createDataFrame([(i + 1, r.id, r.emit) for i, r in enumerate(rules)], "ord int, rule_id string, emit string")


def coverage_totals(df: DataFrame, rules: Sequence[Rule], notional: str) -> DataFrame:
    """Records and notional, in all, matched and unmatched; a missing notional counts 0."""
    x = F.coalesce(F.col(notional), F.lit(0).cast("decimal(18,2)"))
    hit = reduce(lambda a, b: a | b, [r.condition for r in rules])
    total = lambda c: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("decimal(38,2)").cast("double")
    return df.agg(F.count("*").alias("records"), F.count_if(hit).alias("matched_records"), F.count_if(~hit).alias("unmatched_records"), total(F.lit(True)).alias("notional"), total(hit).alias("matched_notional"), total(~hit).alias("unmatched_notional"))


def _by_winner(df: DataFrame, rules: Sequence[Rule], notional: str) -> DataFrame:
    x = F.coalesce(F.col(notional), F.lit(0).cast("decimal(18,2)"))
    return classify(df, rules, "_emit", "rule_id").where("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("records"), F.sum(x).alias("notional"))


def rule_stats(df: DataFrame, rules: Sequence[Rule], notional: str) -> DataFrame:
    """Records and notional of each rule, zero for one that wins nothing."""
    won = _by_winner(df, rules, notional)
    joined = rules_table(df, rules).join(won, "rule_id", "left")
    return joined.select("ord", "rule_id", "emit", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce(F.col("notional").cast("decimal(38,2)"), F.lit(0)).cast("double").alias("notional"))


def value_stats(df: DataFrame, rules: Sequence[Rule], notional: str) -> DataFrame:
    """Records and notional of each emitted value."""
    x = F.coalesce(F.col(notional), F.lit(0).cast("decimal(18,2)"))
    return classify(df, rules, "value").where("value is not null").groupBy("value").agg(F.count("*").alias("records"), F.sum(x).cast("decimal(38,2)").cast("double").alias("notional"))


def _pairs(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(winner, other, records): later rules that matched a winner's rows too. Rows are counted by the pattern of their matches first, so few are expanded."""
    lists = matches(df, rules).where(F.size("_hits") > 1)
    return lists.select(F.col("_hits")[0].alias("winner"), F.explode(F.slice("_hits", 2, len(rules))).alias("other"), "n").groupBy("winner", "other").agg(F.sum("n").alias("records"))


def rule_overlaps(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """For each winner the later rules that also matched."""
    return _pairs(df, rules)


def rule_preemption(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """For each rule the earlier rules that took its rows."""
    return _pairs(df, rules).select(F.col("other").alias("rule_id"), F.col("winner").alias("taken_by"), "records")


def dead_rules(df: DataFrame, rules: Sequence[Rule], notional: str) -> DataFrame:
    """Rules that win nothing: `dead` if they match nothing, `preempted` if earlier rules took all of their rows."""
    taken = rule_preemption(df, rules).groupBy("rule_id").agg(F.sum("records").alias("taken"))
    none = rule_stats(df, rules, notional).where("records = 0")
    return none.join(taken, "rule_id", "left").select("rule_id", F.when(F.col("taken").isNull(), "dead").otherwise("preempted").alias("status"), F.coalesce("taken", F.lit(0)).alias("taken_records"))


def off_domain(df: DataFrame, rules: Sequence[Rule], domain: DataFrame) -> DataFrame:
    """Emitted values that the domain (a column `value`) does not have."""
    return classify(df, rules, "value").where("value is not null").groupBy("value").agg(F.count("*").alias("records")).join(domain.select("value"), "value", "left_anti")


def rules_with_share(df: DataFrame, rules: Sequence[Rule], notional: str) -> DataFrame:
    """Rules in evaluation order with their share of all records and of all notional."""
    all_of = df.agg(F.count("*").alias("all_records"), F.sum(F.coalesce(F.col(notional), F.lit(0).cast("decimal(18,2)"))).cast("double").alias("all_notional"))
    stats = rule_stats(df, rules, notional).crossJoin(F.broadcast(all_of))
    return stats.select("ord", "rule_id", "emit", "records", F.try_divide(F.col("records").cast("double"), F.col("all_records").cast("double")).alias("record_share"), F.try_divide("notional", "all_notional").alias("notional_share"))


def migration(df: DataFrame, before: Sequence[Rule], after: Sequence[Rule], notional: str) -> DataFrame:
    """Records and notional that move between values when one rule set replaces another; both run in one pass."""
    both = classify(classify(df, before, "_a"), after, "_b").where(~F.col("_a").eqNullSafe(F.col("_b")))
    x = F.coalesce(F.col(notional), F.lit(0).cast("decimal(18,2)"))
    grouped = both.groupBy("_a", "_b").agg(F.count("*").alias("records"), F.sum(x).cast("decimal(38,2)").cast("double").alias("notional"))
    return grouped.select(F.coalesce("_a", F.lit(UNMAPPED)).alias("from_value"), F.coalesce("_b", F.lit(UNMAPPED)).alias("to_value"), "records", "notional")


def rule_columns(rules: Sequence[Rule], columns: Sequence[str], most: int = 4) -> list[str]:
    """The columns that a rule set branches on, in the order it names them: strata that keep rare combinations in a sample. The first few, as each one multiplies the strata."""
    named = [w for r in rules for w in re.findall(r"\w+", re.sub(r"'(?:[^']|'')*'", " ", r.when))]
    return [c for c in dict.fromkeys(named) if c in columns][:most]


def duplicate_keys(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lookup keys that are listed more than once."""
    return rates.groupBy(*keys).agg(F.count("*").alias("entries")).where("entries > 1")


def unreadable_rates(rates: DataFrame, value: str) -> DataFrame:
    """Entries whose value is no number."""
    return rates.where(F.expr(f"try_cast({value} as double)").isNull())


def param_lookup(df: DataFrame, rates: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The rate of a row's key columns; null, never 0, for a key that is not listed. Duplicate keys are refused, as they would multiply rows."""
    if not duplicate_keys(rates, keys).isEmpty():
        raise ValueError(f"the lookup lists a key of {', '.join(keys)} more than once")
    return df.join(rates.select(*keys, F.col(value).alias(out)), list(keys), "left")


def rate_misses(df: DataFrame, rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys without a rate, and how many records need it."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("records")).join(rates.select(*keys), list(keys), "left_anti")


def classify_in_force(df: DataFrame, versions: Sequence[tuple[str, str | None, Sequence[Rule]]], date_col: str, column: str) -> DataFrame:
    """Classify each row under the rule set that is in force on its date: (from, to, rules)."""
    branches = []
    for start, end, rules in versions:
        on = (F.col(date_col) >= F.lit(start).cast("date")) & (F.lit(end is None) | (F.col(date_col) < F.lit(end).cast("date")))
        branches.append((on, _first(rules, lambda r: r.emit)))
    return df.withColumn(column, case_value(branches))
