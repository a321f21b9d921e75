"""Personal data: generators propose spans, boosted trees weigh them, calibrated thresholds choose.

Strict generators find the base spans of each kind, which always stay. Generous ones add look-alikes: strict matches
that fail their check, obfuscated addresses, IPv6, numbers grouped otherwise, numbers without a plus sign (none of these inside a strict
match of any kind). Each candidate has
a code of format and context features (a cue word before it, a label sign, glued letters, grouping, length); the
checks themselves are not among them. Whether a strict match holds its check is the label, so the trees say
how often things that look and stand like this are real. Codes are few, so the table of (code, label, fold) counts
over all documents is bounded by their number; gradient boosting with logistic loss runs on that table and the trees
become column expressions. On a second fold, each kind gets the lowest score from which at least PRECISION of the
candidates (with a prior of one wrong in two) are real; look-alikes from there on are added.

Everything on rows is DataFrame functions: a pattern's matches are marked in one replacement, split off, and placed
by adding up lengths. Quantifiers over groups are possessive, so no text, however long, overflows a stack.

Defined cases: null and empty texts have no spans; each row is judged by itself, whatever its doc_id; with no
candidates there are no trees; an empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
PRECISION, LEAST_REAL = 0.95, 20
TREES, DEPTH, RATE = 12, 3, 0.5
CONTEXT = 24

#: Marks matches; where a text holds it, it counts as its neighbour in the private use area.
MARK, INSTEAD = "\ue000", "\ue001"

LOCAL = "A-Za-z0-9._%+-"
#: The rule that a match starts where no earlier start could have reached; \G is where the last match ended.
STRICT = (
    rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
LOOSE = (
    rf"[{LOCAL}]++\x20?[\[({{]\x20?(?:at|AT)\x20?[\])}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({{]\x20?(?:dot|DOT)\x20?[\])}}])\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    r"(?<![0-9./])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9])",
    r"(?<![0-9+./-])(?:00[1-9][0-9]|\(?0[0-9]{1,4}\)?)[\x20./-]{1,2}[0-9]{2,4}[\x20./-]?[0-9]{2,4}(?:[\x20./-]?[0-9]{2,4})?(?![0-9])",
)
#: What a text must hold before a pattern is tried.
NEEDS = ("@", ".", "", "+"), ("at", ":", "", "0")
IP_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CUES = (
    r"(?i)(?:mail|contact|write|kontakt|correo|courriel)",
    r"(?i)(?:\bip\b|host|server|addr|login|client)",
    r"(?i)(?:card|visa|credit|debit|master|payment|karte|tarjeta|carte)",
    r"(?i)(?:tel|phone|call|fax|mobil|cell|whatsapp|contact)",
)
N_BITS = 7

SPAN = "struct<kind:int,s:int,e:int,base:boolean,labelled:boolean,code:int>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """(s, e, t, before) of each match, e exclusive, in code points."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    pieces = F.split(F.when(F.instr(text, needs) > 0, marked).otherwise(F.lit("")) if needs else marked, MARK, -1)
    empty = F.array().cast("array<struct<s:int,e:int,t:string,before:string>>")

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        one = F.struct(state["at"].alias("s"), end.alias("e"), piece.alias("t"), F.substring(state["last"], -CONTEXT, CONTEXT).alias("before"))
        out = F.when(state["inside"], F.concat(state["out"], F.array(one))).otherwise(state["out"])
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), piece.alias("last"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit("").alias("last"), empty.alias("out"))
    return F.aggregate(pieces, start, step, lambda state: state["out"])


def holds(kind: int, t: Column) -> Column:
    """The check of a strict match."""
    digits = F.regexp_replace(t, "[^0-9]", "")
    if kind == 1:
        return t.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == 2:
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == 3:
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _code(kind: int, m: Column, text: Column) -> Column:
    """Format and context of a match, as bits above which stands its kind."""
    t, before, after = m["t"], m["before"], F.substring(text, m["e"] + 1, F.lit(1))
    digits = F.regexp_replace(t, "[^0-9]", "")
    if kind == 0:
        shape = t.rlike(r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"), F.length(t) > 12
    elif kind == 1:
        shape = t.rlike("^(?:10|127|172|192)[.]"), F.length(t) > 9
    elif kind == 2:
        shape = t.rlike(r"^[3-6]"), F.length(digits).isin(15, 16)
    else:
        shape = t.rlike(r"^\+?(?:1|3|4|00)"), F.length(digits).between(10, 13)
    bits = (
        before.rlike(CUES[kind]),
        before.rlike(r"[:=(<#]\x20?$"),
        before.rlike(r"[\p{L}0-9_]$"),
        after.rlike(r"^[\p{L}0-9_@]"),
        t.rlike(r"[\x20()/_-]"),
        *shape,
    )
    number = F.lit(kind << N_BITS)
    for k, bit in enumerate(bits):
        number = number + F.when(bit, 1 << k).otherwise(0)
    return number.cast("int")


def _span(kind: int, strict: bool, text: Column) -> Callable[[Column], Column]:
    def span(m: Column) -> Column:
        base = F.coalesce(holds(kind, m["t"]), F.lit(False)) if strict else F.lit(False)
        parts = F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), base.alias("base"), F.lit(strict).alias("labelled")
        return F.struct(*parts, _code(kind, m, text).alias("code")).cast(SPAN)

    return span


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, spans: all candidates of each text."""
    text = F.col("clean")
    found: dict[bool, list[Column]] = {True: [], False: []}
    for kind in range(len(KINDS)):
        for strict, pattern, needs in ((True, STRICT[kind], NEEDS[0][kind]), (False, LOOSE[kind], NEEDS[1][kind])):
            found[strict].append(F.transform(matches(text, pattern, needs), _span(kind, strict, text)))
    clean = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), MARK, INSTEAD).alias("clean"))
    both = clean.select("doc_id", F.concat(*found[True]).alias("strict"), F.concat(*found[False]).alias("loose"))
    free = F.filter("loose", lambda m: ~F.exists("strict", lambda o: (o["s"] < m["e"]) & (m["s"] < o["e"])))
    return both.select("doc_id", F.concat("strict", free).alias("spans"))


@dataclass
class Node:
    """A split by a bit of the code, or a leaf."""

    value: float = 0.0
    bit: int = -1
    yes: Node | None = None
    no: Node | None = None

    def score(self, code: int) -> float:
        return self.value if self.bit < 0 else (self.yes if code >> self.bit & 1 else self.no).score(code)

    def column(self, code: Column) -> Column:
        if self.bit < 0:
            return F.lit(self.value)
        return F.when(code.bitwiseAND(1 << self.bit) != 0, self.yes.column(code)).otherwise(self.no.column(code))


def boost(counts: dict[int, tuple[float, float]], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list[Node]:
    """Gradient-boosted trees for the log-odds of `real` from (unreal, real) counts by code."""
    scores = dict.fromkeys(counts, 0.0)
    bits = range(N_BITS + len(KINDS).bit_length())

    def grow(codes: list[int], slope: dict[int, float], bend: dict[int, float], left: int) -> Node:
        g, h = sum(slope[c] for c in codes), sum(bend[c] for c in codes)
        best, chosen = 1e-6, -1
        for bit in bits if left else ():
            yes = [c for c in codes if c >> bit & 1]
            if 0 < len(yes) < len(codes):
                gy, hy = sum(slope[c] for c in yes), sum(bend[c] for c in yes)
                gain = gy * gy / (hy + 1) + (g - gy) ** 2 / (h - hy + 1) - g * g / (h + 1)
                if gain > best:
                    best, chosen = gain, bit
        if chosen < 0:
            return Node(rate * g / (h + 1))
        return Node(
            0.0, chosen,
            grow([c for c in codes if c >> chosen & 1], slope, bend, left - 1), grow([c for c in codes if not c >> chosen & 1], slope, bend, left - 1),
        )

    forest = []
    for _ in range(trees if counts else 0):
        chance = {c: 1 / (1 + math.exp(-s)) for c, s in scores.items()}
        slope = {c: counts[c][1] - sum(counts[c]) * chance[c] for c in counts}
        bend = {c: sum(counts[c]) * chance[c] * (1 - chance[c]) for c in counts}
        forest.append(grow(sorted(counts), slope, bend, depth))
        scores = {c: s + forest[-1].score(c) for c, s in scores.items()}
    return forest


def thresholds(forest: Sequence[Node], counts: dict[int, tuple[float, float]], precision: float = PRECISION) -> list[float]:
    """By kind, the lowest score from which on candidates are real often enough; infinity if none."""
    result = []
    for kind in range(len(KINDS)):
        scored = sorted(((sum(t.score(c) for t in forest), n) for c, n in counts.items() if c >> N_BITS == kind), reverse=True)
        real = wrong = 0.0
        found = math.inf
        for k, (score, (n_wrong, n_real)) in enumerate(scored):
            real, wrong = real + n_real, wrong + n_wrong
            last_of_score = k + 1 == len(scored) or scored[k + 1][0] != score
            if last_of_score and real >= LEAST_REAL and (real + 1) / (real + wrong + 2) >= precision:
                found = score
        result.append(found)
    return result


def train(spans: DataFrame) -> tuple[list[Node], list[float]]:
    """Trees from one half of the documents with candidates, thresholds from the other."""
    half = F.pmod(F.xxhash64("doc_id", "spans"), F.lit(2))
    one = spans.select(half.alias("half"), F.explode("spans").alias("m")).where("m.labelled")
    table_ = one.groupBy("half", "m.code", "m.base").agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row a code, label and half
    counts: tuple[dict, dict] = {}, {}
    for half_, code, base, n in table_:
        wrong, real = counts[half_].get(code, (0, 0))
        counts[half_][code] = (wrong, real + n) if base else (wrong + n, real)
    forest = boost(counts[0])
    return forest, thresholds(forest, counts[1])


def find_personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """docs (doc_id, text): doc_id, counts of base spans by kind, base and all spans as texts."""
    spans = stored(candidates(docs), "pii-candidates")
    forest, cutoffs = train(spans)
    names = F.array(*map(F.lit, KINDS))

    def chosen(m: Column) -> Column:
        score = sum((tree.column(m["code"]) for tree in forest), F.lit(0.0))
        keep = m["base"]
        for kind, cutoff in enumerate(cutoffs):
            if cutoff < math.inf:
                keep = keep | ((m["kind"] == kind) & (score >= cutoff - 1e-12))
        return keep

    def joined(which: Column) -> Column:
        placed = F.array_sort(F.transform(which, lambda m: F.struct(m["s"], m["kind"], m["e"])))
        return F.array_join(F.transform(F.array_distinct(placed), lambda m: F.concat_ws(":", names[m["kind"]], m["s"], m["e"])), ",")

    base = F.filter("spans", lambda m: m["base"])
    kinds = F.transform(base, lambda m: m["kind"])
    counted = [F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{name}") for kind, name in enumerate(KINDS)]  # noqa: B023
    return spans.select("doc_id", *counted, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.filter("spans", chosen)).alias("spans"))


def op3_boosted_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents", ["doc_id", "text"]))
