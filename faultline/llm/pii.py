"""Personal data: candidate spans, boosted trees over format and context, calibrated redaction; DataFrame operations only.

Generators propose spans per kind: the base formats, and looser ones (national phone numbers, spelt-out addresses,
secrets). A base candidate is labelled by its check (digit sum, octet range, digit count). A looser one is labelled by
evidence that no feature shows: it lies in a confirmed span of its own kind (positive) or of another (negative); a number
is positive after a cue word, negative with too few or too many digits, and else has no label and teaches nothing, but is
judged; a spelt-out address is positive if its domain ends in a usual way, a secret if an assignment to a usual name stands
before it or it has an issued key's form, and both are negative otherwise. Features are small categories, so all candidates of all
documents reduce to a table bounded by the number of feature combinations; the trees are boosted on that table, and each
looser generator has a threshold of its own.

Work grows with the number of matches of a text but for a logarithm: running ends and maxima are combined in blocks, and
spans that meet are found by binary search.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, written

KINDS = ("email", "ip", "card", "phone", "secret")

# Fixed formats, anchored so that long runs are scanned once; each matches what the plain form does, leftmost first:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.(?![A-Za-z0-9-])))*+"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[0-9\x20-](?<![\x20-](?![0-9])))++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser generators.
TEL = r"(?<![0-9+(])\(?[0-9]{2,4}[)\x20.-]{1,2}[0-9]{2,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?(?![0-9])"
SPELT = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,64} ?[\[(] ?dot ?[\])] ?[A-Za-z]{2,16}"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+(?![A-Za-z0-9_+/-])"

#: Generators: name, kind, pattern, and what a text must hold to be searched.
GENERATORS = (
    ("email", "email", EMAIL, "@"),
    ("ip", "ip", IP, "."),
    ("card", "card", CARD, None),
    ("phone", "phone", PHONE, "+"),
    ("tel", "phone", TEL, None),
    ("spelt", "email", SPELT, None),
    ("secret", "secret", SECRET, None),
)
BASE = 4  # the first generators are the base formats
LOOSER = range(BASE, len(GENERATORS))
CUES = r"(?i)(mail|phone|tel|call|fax|mobile|card|visa|credit|pay|ip|host|address|contact|write)\W{0,4}\w{0,8}\W{0,3}$"
#: What labels looser candidates: words before a phone number, usual domain endings, an assignment to a secret's name.
CALLS = r"(?i)\b(phone|tel|telephone|call|fax|mobile|cell|contact|dial)\b[^0-9A-Za-z]{0,3}(\w{0,8}[^0-9A-Za-z]{1,3})?$"
ENDINGS = r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"
ASSIGNED = r"(?i)(token|secret|key|password|passwd|pwd|auth|bearer|credential)\w{0,12}[\"']?\s{0,2}[:=]\s{0,2}[\"']?$"
# Published prefixes of access keys and tokens.
ISSUED = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,})$"

#: Boosting: rounds, learning rate, least weight of a leaf; precision that the redaction threshold must reach.
ROUNDS, RATE, LEAST = 30, 0.3, 5.0
PRECISION = 0.9
#: Code points of a block of text from which redaction copies.
BLOCK = 256
#: Bits of each feature in the code of a combination, lowest first.
FEATURES = {"generator": 3, "digits": 3, "separator": 3, "before": 2, "after": 2, "cue": 1, "groups": 2}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes(generator: str, match: Column) -> Column:
    """The check of the generator's kind; looser generators have none of their own."""
    if generator == "email":
        return F.lit(True)
    if generator == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255"))
        return F.forall(F.split(match, r"\."), small)
    d = digits(match)
    if generator == "card":
        return F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    if generator == "phone":
        return F.length(d).between(10, 15)
    return F.lit(False)


def evidence(generator: str, match: Column, before: Column) -> Column:
    """What a looser candidate's own text and the words before it tell: 1, 0, or null where nothing tells."""
    near = F.right(before, F.lit(40))
    if generator == "tel":
        return F.when(~F.length(digits(match)).between(9, 11), 0).when(near.rlike(CALLS), 1)
    if generator == "spelt":
        return match.rlike(ENDINGS).cast("int")
    return (near.rlike(ASSIGNED) | match.rlike(ISSUED)).cast("int")


def combination(number: int, match: Column, before: Column, after: Column) -> Column:
    """The feature code of a candidate: its generator, format and context as small categories."""
    n = F.length(digits(match))
    step = lambda c, cuts: functools.reduce(lambda a, b: a + b, [(c >= x).cast("int") for x in cuts])
    sides = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\x09-\x0D\x20]$"), 1).when(c.rlike("^[A-Za-z0-9]$"), 2).otherwise(3)
    has = lambda x: F.contains(match, F.lit(x))
    separator = F.when(has("("), 5).when(has(" ") & has("-"), 4).when(has("."), 3).when(has("-"), 2).when(has(" "), 1).otherwise(0)
    if number >= BASE:  # what labels a looser candidate is no feature of it
        cue = F.lit(0)
    else:
        cue = F.right(before, F.lit(32)).rlike(CUES).cast("int")
    if GENERATORS[number][0] == "secret":  # the alphabet in place of the separator
        separator = F.when(match.rlike("^[0-9]+$"), 5).when(match.rlike("^[0-9a-f]+$"), 0).when(~match.rlike("[0-9]"), 4).when(match.rlike("^[0-9A-Z]+$"), 6).when(~match.rlike("[A-Z]") | ~match.rlike("[a-z]"), 1).when(~has("-") & ~has("_"), 2).otherwise(3)
    parts = {
        "generator": F.lit(number),
        "digits": step(n, (4, 8, 10, 12, 14, 16, 18)),
        "separator": separator,
        "before": sides(F.right(before, F.lit(1))),
        "after": sides(F.left(after, F.lit(1))),
        "cue": cue,
        "groups": step(F.length(F.regexp_replace(match, "[0-9A-Za-z]", "")), (1, 3, 5)),
    }
    code, shift = F.lit(0), 0
    for name, bits in FEATURES.items():
        code, shift = code + F.shiftleft(parts[name], shift), shift + bits
    return code


def proposals(text: Column) -> list[tuple[str, Column, Column]]:
    """For each generator: its name, the matches and the pieces of the text around them (one more than matches)."""
    out = []
    for name, _, pattern, needs in GENERATORS:
        seek = text.rlike("[0-9@\\[(]") if needs is None else F.contains(text, F.lit(needs))
        found = F.when(seek, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        pieces = F.when(seek, F.split(text, pattern, -1)).otherwise(F.array(text))
        out.append((name, found, pieces))
    return out


def described(number: int, name: str):
    """The lambda that makes a span of the generator's i-th match."""
    ends, pieces = F.col(f"{name}_e"), F.col(f"{name}_p")

    def span(match: Column, i: Column) -> Column:
        end = F.get(ends, i)
        code = combination(number, match, F.get(pieces, i), F.get(pieces, i + 1))
        ok = passes(name, match)
        told = evidence(name, match, F.get(pieces, i)) if number >= BASE else ok
        return F.struct((end - F.char_length(match)).alias("start"), end.alias("end"), F.lit(number).alias("generator"), code.alias("code"), ok.alias("ok"), told.cast("int").alias("label"))

    return span


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, part (fold of the document) and spans: (start, end, generator, code, ok, label) of every proposal worth judging."""
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = docs.select(F.col("doc_id").cast("long"), F.pmod(F.crc32(text.cast("binary")), F.lit(2)).alias("part"), text.alias("text"))
    names = [g[0] for g in GENERATORS]
    wide = wide.select("doc_id", "part", *[c.alias(f"{name}_{k}") for name, m, p in proposals(F.col("text")) for k, c in (("m", m), ("p", p))])
    for number, name in enumerate(names):
        m, p = F.col(f"{name}_m"), F.col(f"{name}_p")
        sizes = F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: F.char_length(a) + F.char_length(b))
        wide = wide.withColumn(f"{name}_e", running(sizes, lambda a, b: a + b))  # the end of each match
        wide = wide.withColumn(f"{name}_s", F.transform(m, described(number, name)))
    spans = F.concat(*[F.col(f"{name}_s") for name in names])
    # short runs of digits are no candidates; every confirmed span is
    judged = F.filter(spans, lambda s: s["ok"] | (s["generator"] != 2) | (s["end"] - s["start"] >= 12))
    return wide.select("doc_id", "part", judged.alias("spans"))


def feature(code: int, name: str) -> int:
    shift = 0
    for n, bits in FEATURES.items():
        if n == name:
            return code >> shift & ((1 << bits) - 1)
        shift += bits
    raise KeyError(name)


def boost(table: list[tuple[int, float, float]], rounds: int = ROUNDS, rate: float = RATE, least: float = LEAST) -> tuple[float, list]:
    """Gradient boosting (log loss) of two-level trees over (code, positives, total) rows: the bias and the trees.

    A tree is ((feature, cut), (low side, high side)), a side (feature, cut, low value, high value);
    a row goes low if its feature is less than the cut.
    """
    splits = [(n, c) for n, bits in FEATURES.items() for c in range(1, 1 << bits)]
    low = {s: [feature(code, s[0]) < s[1] for code, _, _ in table] for s in splits}
    pos, total = [r[1] for r in table], [r[2] for r in table]
    bias = math.log((sum(pos) + 1) / (sum(total) - sum(pos) + 1))
    score = [bias] * len(table)

    def best(rows: list[int], g: list[float], h: list[float]):
        """Best split of the rows by the usual second-order gain."""
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        top = (0.0, splits[0], gs / (hs + 1), gs / (hs + 1))
        for s in splits:
            mask = low[s]
            gl = sum(g[i] for i in rows if mask[i])
            hl = sum(h[i] for i in rows if mask[i])
            nl = sum(total[i] for i in rows if mask[i])
            if nl < least or sum(total[i] for i in rows) - nl < least:
                continue
            gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
            if gain > top[0] + 1e-9:
                top = (gain, s, gl / (hl + 1), (gs - gl) / (hs - hl + 1))
        return top

    trees = []
    every = list(range(len(table)))
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [pos[i] - total[i] * p[i] for i in every]
        h = [total[i] * p[i] * (1 - p[i]) for i in every]
        gain, root, _, _ = best(every, g, h)
        if gain <= 1e-6:
            break
        sides = []
        for side in (True, False):
            rows = [i for i in every if low[root][i] == side]
            _, (name, cut), a, b = best(rows, g, h)
            sides.append((name, cut, rate * a, rate * b))
            for i in rows:
                score[i] += rate * (a if low[(name, cut)][i] else b)
        trees.append((root, tuple(sides)))
    return bias, trees


def scored(code: int, model: tuple[float, list]) -> float:
    bias, trees = model
    out = bias
    for (name, cut), sides in trees:
        n, c, a, b = sides[0] if feature(code, name) < cut else sides[1]
        out += a if feature(code, n) < c else b
    return out


def threshold(held: list[tuple[int, float, float]], model: tuple[float, list], precision: float = PRECISION) -> float:
    """Least score that keeps the share of positives, among held-out labelled candidates at or above it, at the wanted precision."""
    rows = sorted(((scored(code, model), pos, total) for code, pos, total in held), reverse=True)
    best, pos, total = math.inf, 0.0, 0.0
    for k, (s, p, n) in enumerate(rows):
        pos, total = pos + p, total + n
        if (k + 1 == len(rows) or rows[k + 1][0] < s) and total and pos / total >= precision:
            best = s
    return best


def selected_codes(found: DataFrame, precision: float = PRECISION) -> list[int]:
    """Codes of looser candidates whose score passes their generator's threshold: trees from the labels of one half of the
    documents, thresholds from the other.

    The grouped table has at most one row for each feature combination and half, whatever the
    input: a bound of 2 ** 17 rows, far fewer in practice.
    """
    flat = found.select("part", F.explode("spans").alias("s"))
    rows = flat.groupBy("part", "s.code").agg(F.coalesce(F.sum("s.label"), F.lit(0)).alias("pos"), F.count("s.label").alias("n")).collect()
    halves: tuple[list, list] = ([], [])
    for r in sorted(rows, key=lambda r: (r["part"], r["code"])):
        halves[r["part"]].append((r["code"], float(r["pos"]), float(r["n"])))
    taught, held = ([row for row in half if row[2]] for half in halves)
    if not taught or not held:
        return []
    model = boost(taught)
    chosen = set()
    for number in range(BASE, len(GENERATORS)):
        least = threshold([row for row in held if feature(row[0], "generator") == number], model, precision)
        chosen |= {code for half in halves for code, _, _ in half if feature(code, "generator") == number and scored(code, model) >= least}
    return sorted(chosen)


def detect(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, base (spans of the base formats) and spans (base and added ones): arrays of (start, kind number, end).

    Positions are code points, end exclusive, sorted by start, then kind. What a looser generator proposes is added if
    the trees score it past its generator's threshold and it meets no base span; of added ones that meet, the longest stays. A
    candidate of a base format that fails its check teaches the trees but is never added. Null text: no spans. Repeated rows and ties: each row on its own. Empty table: no
    rows. Other columns are ignored.
    """
    found = written(labelled(candidates(docs)))
    chosen = selected_codes(found, precision)
    kind = F.array(*[F.lit(KINDS.index(g[1])) for g in GENERATORS])
    plain = lambda s: F.struct(s["start"].alias("start"), F.get(kind, s["generator"]).alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["ok"] & (s["generator"] < BASE)), plain))
    out = found.select("doc_id", "spans", base.alias("base")).withColumn("reach", reach("base", lambda b: b["end"]))

    def added(n: int) -> Column:
        return F.filter("spans", lambda s: (s["generator"] == n) & s["code"].isin(chosen) & ~meeting("reach", s)) if chosen else F.slice("spans", 1, 0)

    def stays(n: int):
        return lambda s: ~functools.reduce(Column.__or__, [larger(f"more_{o}", s) for o in LOOSER if o != n])

    out = out.select("doc_id", "base", *[F.array_sort(added(n)).alias(f"more_{n}") for n in LOOSER])
    more = [F.transform(F.filter(f"more_{n}", stays(n)), plain) for n in LOOSER]
    return out.select("doc_id", "base", F.array_sort(F.concat("base", *more)).alias("spans"))


def before(spans: str, least: Column, field: str = "start") -> Column:
    """How many spans of a column that is sorted by the field, have it below the value: by binary search, in steps that halve."""
    steps = F.sequence(F.length(F.bin(F.size(spans))) - 1, F.lit(0), F.lit(-1))
    here = lambda at, k: at + F.pow(F.lit(2), k).cast("int")
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.coalesce(F.get(spans, here(at, k) - 1)[field] < least, F.lit(False)), here(at, k)).otherwise(at))


def reach(spans: str, *tops) -> Column:
    """The spans by start, each with the running maximum of each of the functions of a span: (start, top0, top1, ...)."""
    names = [f"top{i}" for i in range(len(tops))]
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), *[t(s).alias(n) for t, n in zip(tops, names)])))
    return running(rows, lambda a, b: F.struct(b["start"].alias("start"), *[F.greatest(a[n], b[n]).alias(n) for n in names]))


def meeting(sure: str, s: Column, top: int = 0) -> Column:
    """Whether span s meets one that column sure, made by reach, counts in its maximum of that number."""
    return F.coalesce(F.get(sure, before(sure, s["end"]) - 1)[f"top{top}"] > s["start"], F.lit(False))


def larger(others: str, s: Column) -> Column:
    """Whether span s meets a larger one, then one of a later generator, of another generator's sorted spans. Those do not meet
    each other, so all but the first and the last that s meets lie within s."""
    size = lambda x: F.struct(x["end"] - x["start"], x["generator"])
    beats = lambda o: F.coalesce((o["start"] < s["end"]) & (s["start"] < o["end"]) & (size(o) > size(s)), F.lit(False))
    return beats(F.get(others, before(others, s["end"]) - 1)) | beats(F.get(others, before(others, s["start"] + 1, "end")))


def labelled(found: DataFrame) -> DataFrame:
    """A looser proposal that meets a confirmed base span is positive if one of its own kind is among them, else negative."""
    kind = {n: KINDS.index(g[1]) for n, g in enumerate(GENERATORS)}
    of = lambda n: lambda b: F.when(b["generator"].isin([g for g in range(BASE) if kind[g] == kind[n]]), b["end"]).otherwise(-1)
    sure = found.withColumn("sure", F.filter("spans", lambda s: s["ok"] & (s["generator"] < BASE)))
    sure = sure.withColumn("reach", reach("sure", lambda b: b["end"], *map(of, LOOSER)))
    alike = lambda s: F.coalesce(*[F.when(s["generator"] == n, meeting("reach", s, 1 + i)) for i, n in enumerate(LOOSER)])
    told = lambda s: F.when((s["generator"] < BASE) | ~meeting("reach", s), s["label"]).otherwise(alike(s).cast("int"))
    return sure.select("doc_id", "part", F.transform("spans", lambda s: s.withField("label", told(s))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[redacted]", **options) -> DataFrame:
    """doc_id and text with every detected span replaced. Each row is matched with its own spans by a number of its own, so that null
    and repeated ids are redacted like others and no row is lost or doubled. Null text stays null."""
    rows = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    found = written(detect(rows.select(F.col("row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("row"), "spans")).where(F.size("spans") > 0)
    both = rows.join(found, "row", "left").withColumn("at", running(F.transform("spans", lambda s: s["end"]), F.greatest))
    both = both.withColumn("blocks", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    ends = lambda i: F.when(i > 0, F.get("at", i - 1)).otherwise(0)
    gaps = F.filter(F.transform("spans", lambda s, i: F.struct(ends(i).alias("lo"), s["start"].alias("hi"))), lambda g: g["lo"] <= g["hi"])
    last = F.struct(F.element_at("at", -1).alias("lo"), F.char_length("text").alias("hi"))
    return both.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.concat(gaps, F.array(last)), piece), mark)).alias("text"))


def piece(gap: Column) -> Column:
    """The text from code point lo to hi, from the blocks that hold it."""
    held = F.array_join(F.slice("blocks", F.floor(gap["lo"] / BLOCK).cast("int") + 1, F.floor(gap["hi"] / BLOCK).cast("int") - F.floor(gap["lo"] / BLOCK).cast("int") + 1), "")
    return F.substring(held, gap["lo"] % BLOCK + 1, gap["hi"] - gap["lo"])
