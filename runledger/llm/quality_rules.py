"""Quality rules: base rules, and a decision list learned from labelled documents.

Text statistics are SQL expressions. The list is learned by sequential covering: conditions `feature >= t` or
`feature < t` are added to a conjunction while they gain information on the growing part of the labelled rows, then
trailing conditions are pruned by their worth on the other part; the rows it covers are set aside, and the next rule
is grown on the rest. Spark bins the features and counts the labels of each combination of bins; only those counts,
of MAX_LABELLED documents at most (the ones of least hash), reach the driver. The result is an ordered conditional
expression, which Spark applies to all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, cut, packed

#: Bounds of the learner: labelled documents, thresholds a feature, rules, conditions a rule, documents a rule must cover.
MAX_LABELLED, BINS, MAX_RULES, MAX_CONDITIONS, SUPPORT = 20_000, 24, 8, 3, 6
#: Least share of bad documents among those a rule covers.
PRECISION = 0.97
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: str, drop: str) -> Column:
    return F.length(F.col(text)) - F.length(F.translate(text, drop, ""))


def _repeated(windows: Column) -> Column:
    """Words in windows found twice, from the windows' fingerprints."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    # The one-element array binds the sorted windows to a name, so that they are sorted once.
    found = F.array_sort(F.get(F.transform(F.array(ordered), places), 0))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    return F.aggregate(found, start, step, lambda acc: acc["n"])


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, more, the statistics of STATS, and n_lines, n_upper, n_bangs of every row of docs.

    A null text counts as empty. Other columns are ignored."""
    text = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    names = text.columns[2:]
    parts = text.withColumn("words", F.array_remove(F.split("text", SPACE), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    parts = parts.select(
        "doc_id",
        *names,
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        _without("text", "#*$%&|<>").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"),
        F.size("lines").cast("bigint").alias("n_lines"),
        _without("text", UPPER).cast("bigint").alias("n_upper"),
        _without("text", "!").cast("bigint").alias("n_bangs"),
    )
    none = F.size(F.array_distinct("windows")) == F.size("windows")
    return parts.withColumn("n_repeat_words", F.when(none, F.lit(0).cast("bigint")).otherwise(_repeated(F.col("windows")))).drop("windows")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


FEATURES: dict[str, Column | None] = dict.fromkeys(("words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "bangs", "words_a_line"))


def features(stats: DataFrame) -> DataFrame:
    """Ratios for the learner, as f_<name>."""
    made = {
        "words": F.col("n_words").cast("double"),
        "mean_word": _ratio("word_chars", "n_words"),
        "symbols": _ratio("n_symbols", "word_chars"),
        "dup_lines": _ratio("n_dup_lines", "n_lines"),
        "repeats": _ratio("n_repeat_words", "n_words"),
        "upper": _ratio("n_upper", "word_chars"),
        "bangs": _ratio("n_bangs", "n_words"),
        "words_a_line": _ratio("n_words", "n_lines"),
    }
    return stats.withColumns({f"f_{k}": made[k] for k in FEATURES})


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(f"f_{self.feature}")
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Cell = tuple[tuple[int, ...], tuple[int, int, int, int]]


def _best(cells: list[Cell], features: list[int]) -> tuple[float, int, bool, int] | None:
    """The condition of most information gain: (gain, feature, at least, bin)."""
    good, bad = sum(c[1][1] for c in cells), sum(c[1][0] for c in cells)
    if not bad or not good:
        return None
    base, best = math.log2(bad / (bad + good)), None
    for f in features:
        per: dict[int, list[int]] = {}
        for bins, (b, g, _, _) in cells:
            x = per.setdefault(bins[f], [0, 0])
            x[0] += b
            x[1] += g
        b_low = g_low = 0
        for k in sorted(per)[:-1]:
            b_low, g_low = b_low + per[k][0], g_low + per[k][1]
            for at_least, b, g in ((False, b_low, g_low), (True, bad - b_low, good - g_low)):
                if b and (gain := b * (math.log2(b / (b + g)) - base)) > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, at_least, k + 1
    return best


def _covers(rule: list[tuple[int, bool, int]], bins: tuple[int, ...]) -> bool:
    return all((bins[f] >= k) == at_least for f, at_least, k in rule)


def cover(cells: list[Cell], width: int) -> list[list[tuple[int, bool, int]]]:
    """Ordered rules for bad documents from (bins, (bad and good to grow on, bad and good to prune on)).

    A rule that is not precise enough is dropped, and the next try uses no feature that such a rule began with."""
    rules: list[list[tuple[int, bool, int]]] = []
    failed: set[int] = set()
    while len(rules) < MAX_RULES:
        rule: list[tuple[int, bool, int]] = []
        inside = cells
        while len(rule) < MAX_CONDITIONS and (step := _best(inside, [f for f in range(width) if f not in failed])):
            rule.append(step[1:])
            inside = [c for c in inside if _covers(rule[-1:], c[0])]

        def worth(r: list[tuple[int, bool, int]]) -> tuple[float, int]:
            hit = [c[1] for c in cells if _covers(r, c[0])]
            b, g = sum(x[2] for x in hit), sum(x[3] for x in hit)
            return (b - g) / (b + g) if b + g else -1.0, b

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule.pop()
        hit = [c[1] for c in cells if _covers(rule, c[0])] if rule else []
        bad, good = sum(x[0] + x[2] for x in hit), sum(x[1] + x[3] for x in hit)
        if not rule:
            break
        if bad < SUPPORT or bad / (bad + good) < PRECISION:
            failed.add(rule[0][0])
            continue
        failed.clear()
        rules.append(rule)
        cells = [c for c in cells if not _covers(rule, c[0])]
    return rules


def learn(rows: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules for documents of quality 0, from features() of the documents and labels (doc_id, quality).

    Labels that are null or of unknown documents are left out; without labels of both kinds there are no rules."""
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int")).where("quality in (0, 1) and doc_id is not null")
    sample = rows.select("doc_id", *(f"f_{k}" for k in FEATURES)).join(known, "doc_id")
    sample = cut(sample.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_LABELLED))
    steps = F.array(*(F.lit(i / (BINS + 1)) for i in range(1, BINS + 1)))
    bad = sample.where("quality = 0")
    cuts: dict[str, list[float]] = {k: [] for k in FEATURES}
    for part in (sample, bad):
        got = part.agg(*(F.percentile(f"f_{k}", steps).alias(k) for k in FEATURES)).first()
        for k in FEATURES:
            cuts[k] = sorted({*cuts[k], *(float(x) for x in got[k] or ())})
    binned = [sum((F.when(F.col(f"f_{k}") >= t, 1).otherwise(0) for t in cuts[k]), F.lit(0)).alias(k) for k in FEATURES]
    grow = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)) > 0
    n = lambda q, g: F.count_if((F.col("quality") == q) & (grow if g else ~grow))
    counts = sample.select(*binned, "quality", "doc_id").groupBy(*FEATURES).agg(n(0, True).alias("b1"), n(1, True).alias("g1"), n(0, False).alias("b2"), n(1, False).alias("g2"))
    cells = sorted((tuple(r[k] for k in FEATURES), (r.b1, r.g1, r.b2, r.g2)) for r in counts.collect())
    names = list(FEATURES)
    return [[Condition(names[f], at_least, cuts[names[f]][k - 1]) for f, at_least, k in rule] for rule in cover(cells, len(names))]


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out: Column | None = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed, rule (0: none) and kept of every row of docs.

    Null and empty texts fail the base rules. Rows that repeat a doc_id are judged one by one."""
    rows = features(cut(statistics(docs)))
    judged = rows.select("doc_id", *STATS, F.coalesce(base_failed(), F.lit(True)).alias("base_failed"), verdict(learn(rows, labels)).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, once each, with all their columns.

    Rows are matched by doc_id and a fingerprint of the text, on which alone the verdict depends."""
    mark = F.xxhash64(F.col("text").cast("string"))
    rows = features(cut(statistics(docs, mark.alias("key_text"))))
    good = ~F.coalesce(base_failed(), F.lit(True)) & (verdict(learn(rows, labels)) == 0)
    gone = cut(rows.where(~good).select(F.col("doc_id").alias("gone_id"), F.col("key_text").alias("gone_text")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    all_ = packed(docs, key_id=F.col("doc_id").cast("bigint"), key_text=mark)
    return all_.join(gone, F.col("key_id").eqNullSafe(F.col("gone_id")) & (F.col("key_text") == F.col("gone_text")), "left_anti").select("row.*")
