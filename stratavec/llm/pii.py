r"""Personal data by gradient boosting over candidate spans, in built-in expressions only.

Generators with high recall propose spans, which may overlap. Base spans (the plain patterns with
their checks) always stay, and candidates that overlap one are none. Every other candidate becomes a
small vector of binned features of its context and format; boosted trees score it; a threshold per
generator, calibrated on folds that the scoring trees have not seen, selects redactions, and the
best-scored of overlapping ones stay.

Training needs no labels from outside: every pattern, the base ones included, has a strict check (card checksum,
area codes, an assigned value of mixed characters, ...), and the trees learn from all its matches,
those that pass and those that fail, how likely a match is the real thing, given how it looks and where it
stands. The generators are of two sorts. For those whose check is a rule on digits that a random number
passes with a known probability (``CHANCE``), the check stays necessary, and the failures in a range of scores
tell how many of its passes are look-alikes: a threshold is the smallest score above which they are at
most one in ten. ``prior`` genuine passes are assumed beforehand. For the others (``JUDGED``) the trees decide: all candidates above a threshold
are selected, whether they pass the check or not, and it lies where passes outweigh failures most, a failure being as dear as nine
passes; where they never do, nothing is selected. Where a table holds fewer than ``prior`` passes of a judged generator,
nothing can be calibrated, and its check decides.

All features are binned, so the training set is a contingency table (a count of passes and failures
for each distinct vector and fold) that one map-side combined aggregation over every candidate
yields; its size is bounded by the bins, not by the data. Boosting that table takes moments on the
driver, and the trees become CASE expressions.

The patterns are written so that Java's matcher needs linear time and constant stack on any text:
possessive runs, and a run may only be entered at its start or where the last match ended.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, written

#: The base patterns, in the order in which kinds are listed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any text with a match passes.
GATE = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?+[0-9]){9}",
    "phone": "+",
}
#: Further generators: name, kind of the spans, pattern, gate.
EXTRA = [
    ("spelled_email", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20[\[(]?at[\])]?\x20[A-Za-z0-9-]{1,63}+\x20[\[(]?dot[\])]?\x20[A-Za-z]{2,}+", r"\x20[\[(]?dot[\])]?\x20"),
    ("local_phone", "phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    ("short_card", "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,14}+(?![\x20-]?[0-9])", r"[0-9](?:[\x20-]?+[0-9]){12}"),
    ("national_id", "id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    # Assigned values, and any run of letters and digits that might be one.
    ("secret", "secret", r"(?<![A-Za-z0-9_])(?i:token|secret|password|passwd|api_?key|access_?key)\x20?[=:]\x20?[\x22'][^\x22'\s]{8,200}+[\x22']|(?<![A-Za-z0-9])(?=[A-Za-z]{0,100}+[0-9])[A-Za-z0-9]{8,200}+(?![A-Za-z0-9])", r"(?i)(?:token|secret|passw|key)[a-z]*+\x20?[=:]\x20?[\x22']|[0-9][A-Za-z0-9]{7}|[A-Za-z0-9]{7}[0-9]|[A-Za-z0-9]{4}[0-9][A-Za-z0-9]{3}|[A-Za-z]{1,100}+[0-9][A-Za-z0-9]"),
]
KINDS = ["email", "ip", "card", "phone", "id", "secret"]
GENERATORS = [name for name, *_ in EXTRA]
#: The probability that random digits pass a generator's check: two digits from 2 to 9; the last of a checksum; neither 000, 666
#: nor 9xx, not 00, not 0000.
CHANCE = {"local_phone": 0.8 * 0.8, "short_card": 0.1, "national_id": 0.898 * 0.99 * 0.9999}
#: Generators whose spans the trees alone decide about.
JUDGED = [name for name in GENERATORS if name not in CHANCE]
#: Context before format: of equally good splits the first is taken.
FEATURES = ["generator", "cue", "before", "after", "marks", "size", "digits"]
CONTEXT = 24


@dataclass(frozen=True)
class BoostSettings:
    """rounds trees of depth two at this learning rate; thresholds keep this precision over
    ``folds`` folds (by crc32 of the id), each scored by trees fitted on the others."""

    rounds: int = 40
    rate: float = 0.3
    folds: int = 5
    precision: float = 0.9
    prior: float = 10.0


# ---------------------------------------------------------------- candidates

def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, doubled at every second place from the right, sum to a multiple of ten."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    weigh = F.transform(places, lambda i: F.when(
        (n - i) % 2 == 1,
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1),
    ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(weigh, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _base_check(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3)
                        & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(8, 15)


def _strict(generator: str, value: Column) -> Column:
    """The label: whether the candidate passes its generator's strict check."""
    if generator == "spelled_email":
        return value.rlike(r"dot[\])]? [A-Za-z]{2,6}$") & value.rlike(r"[\[(](?:at|dot)|[0-9._]")
    if generator == "short_card":
        return _luhn(_digits(value))
    if generator == "local_phone":
        return _digits(value).rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$")
    if generator == "national_id":
        return ~value.rlike(r"^(?:000|666|9)") & ~value.rlike(r"-00-|-0000$")
    if generator in BASE:
        return _base_check(generator, value)
    inside = F.regexp_extract(value, r"[\x22']([^\x22']*)[\x22']", 1)
    return inside.rlike("[0-9]") & inside.rlike("[A-Za-z]") & (F.length(inside) >= 16)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all leftmost non-overlapping matches; starts in code points.

    split() gives the gaps between matches, so running lengths give the places.
    """
    empty = F.array().cast("array<struct<start:int,value:string>>")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        return F.when(pair["hit"].isNull(), acc).otherwise(F.struct(
            (start + F.length(pair["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), pair["hit"].alias("value")))).alias("out")))

    return F.aggregate(pairs, begin, step, lambda acc: acc["out"])


def _char_class(c: Column) -> Column:
    return (F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2)
            .when(c.rlike(r"\p{L}"), 3).when(c.rlike("[\"'=:]"), 4).otherwise(5))


def _bin(n: Column, *edges: int) -> Column:
    out = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        out = F.when(n <= edge, i).otherwise(out)
    return out


def _described(text: Column, name: str, kind: str, number: int, pattern: str, gate: str) -> Column:
    """All matches of a pattern with the outcome of its check and their features, as an array of structs."""

    def describe(s: Column) -> Column:
        value, start = s["value"], s["start"]
        length = F.length(value)
        left = F.when(start > 0, F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))).otherwise(F.lit(""))
        after = F.substring(text, start + length + 1, F.lit(1))
        assigned = F.lit(name == "secret") & value.rlike("[=:]")
        cue = (F.when(assigned, 3).when(left.rlike(r"(?i)token|secret|passw|key"), 2)
               .when(left.rlike(r"(?i)card|phone|tel\b|call|mail|address|\bip\b|host|ssn"), 1).otherwise(0))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            start.alias("start"),
            (start + length).alias("end"),
            F.coalesce(_strict(name, value), F.lit(False)).cast("int").alias("strict"),
            F.lit(number).alias("generator"),
            cue.alias("cue"),
            _char_class(F.substring(left, -1, 1)).alias("before"),
            _char_class(after).alias("after"),
            _bin(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), 0, 1, 2, 3, 5).alias("marks"),
            _bin(length, 7, 9, 11, 12, 13, 14, 15, 16, 17, 19, 23, 31, 47).alias("size"),
            _bin(F.length(_digits(value)), 0, 2, 7, 9, 10, 12, 13, 14, 15, 16, 19).alias("digits"),
        )

    none = F.array().cast(CANDIDATES)
    return F.when(_gate(text, gate), F.transform(_spans(text, pattern), describe).cast(CANDIDATES)).otherwise(none)


SPANS = "array<struct<kind:int,start:int,end:int>>"
CANDIDATES = "array<struct<kind:int,start:int,end:int,strict:int," + ",".join(f"{f}:int" for f in FEATURES) + ">>"


def _gate(text: Column, gate: str) -> Column:
    return F.contains(text, F.lit(gate)) if gate in ("@", "+") else text.rlike(gate)


def proposed(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with columns __seen (all matches of the base patterns, with their outcomes), __sure (the base spans,
    in order) and __more (the candidates of the other generators that overlap none of them); no shuffle."""
    seen = F.concat(*[_described(text, kind, kind, len(EXTRA) + i, BASE[kind], GATE[kind]) for i, kind in enumerate(BASE)])
    more = F.concat(*[_described(text, name, kind, i, pattern, gate) for i, (name, kind, pattern, gate) in enumerate(EXTRA)])
    passing = F.expr(f"array_sort(transform(filter(__seen, c -> c.strict = 1), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end)))")
    found = df.withColumn("__seen", seen).withColumn("__sure", passing.cast(SPANS))
    return found.withColumn("__more", F.filter(more, lambda c: ~F.exists("__sure", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))


def propose(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, __seen, __sure, __more) for every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return proposed(base, F.col("text")).drop("text")


# ---------------------------------------------------------------- boosting

def _grow(vectors: np.ndarray, g: np.ndarray, h: np.ndarray, gain_floor: float = 1e-6):
    """The best tree of depth two over weighted rows (vector, gradient, hessian): nested splits."""

    def split(rows):
        best = (gain_floor, None)
        whole, weight = g[rows].sum(), h[rows].sum()
        for f in range(vectors.shape[1]):
            values = vectors[rows, f]
            left, under = np.cumsum(np.bincount(values, g[rows])), np.cumsum(np.bincount(values, h[rows]))
            for value in np.unique(values)[:-1].tolist():
                gl, hl = left[value], under[value]
                gain = gl * gl / (hl + 1) + (whole - gl) ** 2 / (weight - hl + 1) - whole * whole / (weight + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, value))
        return best[1]

    def build(rows, depth):
        at = split(rows) if depth else None
        if at is None:
            return float(g[rows].sum() / (h[rows].sum() + 1.0))
        f, value = at
        low = vectors[rows, f] <= value
        return (f, value, build(rows[low], depth - 1), build(rows[~low], depth - 1))

    return build(np.arange(len(vectors)), 2)


def _values(tree, vectors: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(vectors), tree)
    f, at, low, high = tree
    return np.where(vectors[:, f] <= at, _values(low, vectors), _values(high, vectors))


def boost(vectors: np.ndarray, failed: np.ndarray, passed: np.ndarray, settings: BoostSettings):
    """Gradient boosting (logistic loss) on a contingency table: distinct vectors with failures and passes."""
    n, p = failed + passed, passed.astype(float)
    start = math.log((p.sum() + 1) / (failed.sum() + 1))
    scores, trees = np.full(len(vectors), start), []
    for _ in range(settings.rounds if failed.any() and passed.any() else 0):
        q = 1 / (1 + np.exp(-scores))
        tree = _grow(vectors, p - n * q, n * q * (1 - q))
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        scores = scores + settings.rate * _values(tree, vectors)
    return start, trees


def _probabilities(model, vectors: np.ndarray, rate: float) -> np.ndarray:
    start, trees = model
    return 1 / (1 + np.exp(-sum((rate * _values(t, vectors) for t in trees), np.full(len(vectors), start))))


def calibrate(scored: list[tuple[int, float, int, int]], settings: BoostSettings) -> dict[int, float | None]:
    """For each generator the score from which its candidates are selected, of (generator, score, failures,
    passes); 2.0 selects nothing. Checked generators take the smallest score from which the precision holds. For
    judged ones a wrong span costs as many right ones as the precision allows for it: the best balance
    counts, and the threshold lies halfway to the next score below. A generator with too few passes to tell
    has None: its check alone decides."""
    dear = settings.precision / (1 - settings.precision)
    out = {}
    for g, name in enumerate(GENERATORS):
        rows = sorted(((score, n, p) for of, score, n, p in scored if of == g), reverse=True)
        if not rows or (name in JUDGED and sum(p for *_, p in rows) < settings.prior):
            out[g] = None
            continue
        threshold, balance, good, bad, i = 2.0, 0.0, 0, 0, 0
        while i < len(rows):
            score = rows[i][0]
            while i < len(rows) and rows[i][0] == score:
                bad, good, i = bad + rows[i][1], good + rows[i][2], i + 1
            if name not in JUDGED:
                if bad * CHANCE[name] / (1 - CHANCE[name]) * (dear + 1) <= good + settings.prior:
                    threshold = score
            elif good - dear * bad > balance:
                balance = good - dear * bad
                threshold = (score + (rows[i][0] if i < len(rows) else score)) / 2
        out[g] = threshold
    return out


def _tree_sql(tree, item: str) -> str:
    if not isinstance(tree, tuple):
        return f"{float(tree)!r}D"
    f, at, low, high = tree
    return f"CASE WHEN {item}.{FEATURES[f]} <= {at} THEN {_tree_sql(low, item)} ELSE {_tree_sql(high, item)} END"


def fit(candidates: DataFrame, settings: BoostSettings = BoostSettings()):
    """(model, thresholds) from a table of (doc_id, __seen, __more)."""
    one = candidates.select(fold(F.col("doc_id"), settings.folds).alias("fold"), F.explode(F.concat("__seen", "__more")).alias("c"))
    cells = (one.groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
             .agg(F.sum(1 - F.col("c.strict")).alias("failed"), F.sum(F.col("c.strict")).alias("passed")))
    rows = cells.orderBy("fold", *FEATURES).collect()  # at most the product of the bins
    table = np.array([[r["fold"], *[r[f] for f in FEATURES], r["failed"], r["passed"]] for r in rows], dtype=np.int64).reshape(len(rows), len(FEATURES) + 3)

    def learnt(part: np.ndarray):
        vectors, place = np.unique(part[:, 1:-2], axis=0, return_inverse=True)
        failed, passed = (np.bincount(place.ravel(), part[:, c], len(vectors)).astype(np.int64) for c in (-2, -1))
        return boost(vectors, failed, passed, settings)

    scored = []
    for k in np.unique(table[:, 0]).tolist():
        held = table[table[:, 0] == k]
        scores = _probabilities(learnt(table[table[:, 0] != k]), held[:, 1:-2], settings.rate)
        scored += zip(held[:, 1].tolist(), scores.tolist(), held[:, -2].tolist(), held[:, -1].tolist())
    return learnt(table), calibrate(scored, settings)


# ---------------------------------------------------------------- selection

NAMES = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
SPAN_TEXT = f"array_join(transform({{}}, s -> concat({NAMES}[s.kind], ':', s.start, ':', s.end)), ',')"


def select_spans(df: DataFrame, model, thresholds: dict[int, float | None], settings: BoostSettings) -> DataFrame:
    """``df`` (with __sure and __more) with column __found: all selected spans, by kind and start."""
    start, trees = model
    margin = " + ".join([f"{start!r}D", *[f"{settings.rate!r}D * ({_tree_sql(t, 'c')})" for t in trees]])
    limits = "map(" + ", ".join(f"{g}, {t or 0.0!r}D" for g, t in thresholds.items()) + ")"
    decided = [str(g) for g, name in enumerate(GENERATORS) if name in JUDGED and thresholds[g] is not None]
    free = f" OR c.generator IN ({', '.join(decided)})" if decided else ""
    scored = df.withColumn("__scored", F.expr(
        f"transform(filter(__more, c -> c.strict = 1{free}), c -> struct(c.kind AS kind, c.start AS start, c.end AS end, false AS base, "
        f"c.generator AS generator, 1D / (1D + exp(-({margin}))) AS score))"))
    best_first = ("CASE WHEN l.score > r.score THEN -1 WHEN l.score < r.score THEN 1 WHEN l.start < r.start THEN -1 "
                  "WHEN l.start > r.start THEN 1 WHEN l.generator < r.generator THEN -1 WHEN l.generator > r.generator THEN 1 ELSE 0 END")
    chosen = scored.withColumn("__scored", F.expr(f"array_sort(filter(__scored, c -> c.score >= {limits}[c.generator]), (l, r) -> {best_first})"))
    apart = F.expr("aggregate(__scored, filter(__scored, c -> false), (got, c) -> "
                   "CASE WHEN exists(got, b -> b.start < c.end AND c.start < b.end) THEN got ELSE concat(got, array(c)) END)")
    sure = F.expr("transform(__sure, s -> struct(s.kind AS kind, s.start AS start, s.end AS end, true AS base, -1 AS generator, 1D AS score))")
    return chosen.withColumn("__found", F.array_sort(F.concat(sure, apart))).drop("__scored")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: BoostSettings = BoostSettings()) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, found.

    The counts and base_sha256 are of the base spans; spans and n_spans add those that the trees
    select, and found has them all as structs (kind, start, end, base, score). Texts are searched
    whole; null texts count as empty and have no spans; offsets count code points, ends excluded;
    repeated rows give repeated results; other columns are not read. The candidates (a few small
    structs for a text that holds any, no text) are written once, so both training and scoring read
    them.
    """
    staged = written(propose(docs, id_col, text_col), "pii-candidates")
    model, thresholds = fit(staged, settings)
    final = select_spans(staged, model, thresholds, settings)
    return final.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(__sure, s -> s.kind = {i})) AS BIGINT) AS n_{k}") for i, k in enumerate(BASE)],
        F.sha2(F.expr(SPAN_TEXT.format("__sure")), 256).alias("base_sha256"),
        F.expr(SPAN_TEXT.format("__found")).alias("spans"),
        F.size("__found").cast("long").alias("n_spans"),
        F.expr(f"transform(__found, s -> struct({NAMES}[s.kind] AS kind, s.start AS start, s.end AS end, s.base AS base, s.score AS score))").alias("found"),
    )


def redacted(text: Column, found: Column) -> Column:
    """The text with every span of ``found`` (structs with kind, start, end) replaced by its kind in
    brackets, such as [EMAIL].

    Spans are merged from left to right: one that begins inside its predecessor adds no mark, and
    one that ends beyond it extends the cut.
    """
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    spans = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, mark)).alias("out"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: BoostSettings = BoostSettings()) -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; every row stays, null texts stay null.

    The trees are fitted in a pass of their own; then each row's candidates are proposed, scored
    and replaced beside its text, so no row is joined or shuffled.
    """
    model, thresholds = fit(propose(docs, id_col, text_col), settings)
    marked = select_spans(proposed(docs, F.coalesce(F.col(text_col), F.lit(""))), model, thresholds, settings)
    changed = F.when(F.size("__found") > 0, redacted(F.col(text_col), F.col("__found"))).otherwise(F.col(text_col))
    return marked.withColumn(text_col, changed).select(*docs.columns)
