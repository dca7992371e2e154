"""Personal data: generators of candidate spans, boosted trees that judge them, calibrated thresholds.

Plain patterns with checks (octets, check digits, digit counts) find the base spans of each kind, and these always stay. Wider
generators propose further spans that may overlap: written-out and spaced e-mail addresses, addresses with other
separators, grouped numbers without a country code, and long mixed strings that may be keys. Gradient-boosted trees score each proposal by its format and the
words around it, and a threshold calibrated for each kind decides. Spans, features and scores are DataFrame
expressions; the trees are fitted by Spark ML on a bounded sample and then written out as one expression.

The trees' training rows are contexts from the corpus into which a formatted item has been put: numbers and addresses as people
write them count as personal data, and look-alikes (dates, prices, versions, counts, failing check digits) do not.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgraph.llm.shared import cut

KINDS = ("email", "ip", "card", "phone")
#: Kinds that have proposals; secrets have no base pattern.
PROPOSED = (*KINDS, "secret")
#: Contexts that training items are put into, at most.
CONTEXTS = 3_000
#: Of the held-out look-alikes of a kind, the share that a threshold may let through.
FALSE_RATE = 0.002
TREES, DEPTH = 12, 3
#: Characters on each side of a candidate from which context features are taken.
AROUND = 24

# Fixed patterns of the base kinds. Possessive runs and the condition before a run keep matching linear without changing
# which spans match: a run that fails from its first character fails from any other.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns of the candidate generators, by kind.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20|\x20@\x20)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:00[1-9][0-9\x20().-]{7,18}[0-9]|\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[0-9]{2,4}[\x20/-][0-9]{5,8})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{20,256}+(?![A-Za-z0-9+/_-])",
}
#: What must be in a text for a kind's base pattern to be tried at all.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_PHONE_WORDS, _OTHER_WORDS = r"(?i)(?:tel|phone|call|fax|mobile|cell|ruf|appel|llam|contact)", r"(?i)(?:page|isbn|version|no|nr|id|order|date|price|total|year|ref|doi|vol)"

_NAMED = r"(?i)(?:key|token|secret|passw|passwd|pwd|auth|credential)[A-Za-z_]{0,16}[\"']?\s{0,2}[:=]\s{0,2}[\"']?$"
_HASHED = r"(?i)(?:sha|md5|commit|checksum|hash|digest|etag|rev|id)[A-Za-z0-9_-]{0,8}[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scan(xs: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Goes through an array with a state; step gives the next state and an array of what comes out, of elements of this kind.

    Arrays are built by copying, so the way goes in blocks of about the root of the length: n elements cost n ** 1.5 small copies."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    def whole(v):
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / w).cast("int") - 1), lambda k: F.slice(v, k * w + 1, w)))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        return F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["outs"]))

    return let(xs, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda c, i: c.try_cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The check that a base match must pass."""
    n = F.length(digits_of(s))
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits_of(s))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


_SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (s, e, m, before, after): code points from, to (exclusive), the matched text, and the
    text around it, before it back to the last match at most.

    Each match is taken with the gap before it; a last empty match takes the tail, so no gap is searched twice."""
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)(?=(.{{0,{AROUND}}}))")
    parts = [F.regexp_extract_all(text, whole, F.lit(k)).alias(name) for k, name in enumerate(("g", "m", "after"), 1)]

    def step(at, x):
        s = at + F.length(x["g"])
        e = s + F.length(x["m"])
        found = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.substring(x["g"], -AROUND, AROUND).alias("before"), x["after"].alias("after"))
        return e, F.when(F.length(x["m"]) > 0, F.array(found)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return scan(F.arrays_zip(*parts), F.lit(0), step, _SPAN)


def base_spans(text: Column, kind: str) -> Column:
    """Base spans of a kind; texts without its hint are not searched."""
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(_HINT[kind]), F.filter(spans(text, BASE[kind]), lambda x: valid(kind, x["m"]))).otherwise(none)


FEATURES = ("chars", "digits", "letters", "groups", "seps", "dots", "brackets", "spaces", "zero_first", "luhn_ok", "even_groups", "before_letter", "before_digit", "after_letter", "after_digit", "phone_word", "other_word", "currency", "known_end", "octets_ok", "area_ok", "named", "hashed", "hex", "capitals", "kinds_of_character")


def features(m: Column, before: Column, after: Column, kind: Column) -> dict[str, Column]:
    """Format and context features of a candidate, as numbers."""
    d, flag = digits_of(m), lambda c: F.coalesce(c, F.lit(False)).cast("double")
    groups = F.split(F.regexp_replace(m, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    count = lambda p: (F.length(m) - F.length(F.regexp_replace(m, p, ""))).cast("double")
    return {
        "chars": F.length(m).cast("double"), "digits": F.length(d).cast("double"), "letters": count("[A-Za-z]"),
        "groups": F.size(groups).cast("double"), "seps": count("[._/-]"), "dots": count(r"\."), "brackets": count(r"[\[\](){}]"), "spaces": count(r"\x20"),
        "zero_first": flag(d.startswith("0")), "luhn_ok": flag(F.when(F.length(d).between(13, 19), luhn(d))), "even_groups": flag(m.rlike(r"^[^0-9]*([0-9]{4}[^0-9]+){3}[0-9]{4}$")),
        "before_letter": flag(before.rlike(r"\p{L}$")), "before_digit": flag(before.rlike(r"[0-9][.,:/\x20-]?$")), "after_letter": flag(after.rlike(r"^\p{L}")), "after_digit": flag(after.rlike(r"^[.,:/\x20-]?[0-9]")),
        "phone_word": flag(before.rlike(_PHONE_WORDS)), "other_word": flag(before.rlike(_OTHER_WORDS + r"[^0-9]{0,6}$")), "currency": flag(before.rlike(r"[$€£#]\x20?$") | after.rlike(r"^\x20?[%€$£]")),
        "known_end": flag(m.rlike(r"(?i)[.\])}\x20](?:com|net|org|edu|gov|io|de|fr|es|uk)$")),
        "octets_ok": flag((F.size(groups) == 4) & F.forall(groups, lambda x: x.try_cast("int") <= 255)), "area_ok": flag(m.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$")),
        "named": flag(before.rlike(_NAMED)), "hashed": flag(before.rlike(_HASHED)), "hex": flag(m.rlike("^[0-9a-f]+$")), "capitals": count("[A-Z]"),
        "kinds_of_character": F.size(F.array_distinct(F.split(m, "(?<=.)(?=.)"))).cast("double"),
    }


def training_rows(docs: DataFrame, text_col: str = "text", contexts: int = CONTEXTS) -> DataFrame:
    """(kind, label, features): look-alikes and personal items put into contexts of the corpus, at most contexts of them.

    A context is the text around a point drawn by a hash; the bound keeps the sample small whatever the corpus."""
    t = F.col(text_col)
    at = F.pmod(F.xxhash64(t), F.length(t).cast("long")).cast("int")
    around = docs.where(F.length(t) > 0).select(F.xxhash64(t).alias("h"), F.substring(t, F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND))).alias("b"), F.substring(t, at + 1, F.lit(AROUND)).alias("a"))
    ctx = cut(around.dropDuplicates(["h"]).orderBy("h").limit(contexts))
    n = lambda k, lo, hi: (F.pmod(F.xxhash64("h", F.lit(k)), F.lit(hi - lo + 1)) + lo).cast("string")
    z = lambda k, w: F.lpad(F.pmod(F.xxhash64("h", F.lit(k)), F.lit(10**w)).cast("string"), w, "0")
    word = lambda k: F.translate(F.substring(F.md5(F.concat(F.col("h").cast("string"), F.lit(str(k)))), 1, 7), "0123456789", "ghijklmnop")
    raw = F.concat(F.lit("4"), z(30, 14))
    sums = F.aggregate(F.transform(F.split(F.reverse(F.concat(raw, F.lit("0"))), "(?<=.)(?=.)"), lambda c, i: c.cast("int") * (1 + i % 2)), F.lit(0), lambda x, y: x + F.when(y > 9, y - 9).otherwise(y))
    card = F.concat(raw, F.pmod(10 - sums % 10, F.lit(10)).cast("string"))
    failing = F.concat(raw, F.pmod(10 - sums % 10 + n(20, 1, 9).cast("int"), F.lit(10)).cast("string"))
    dot_of = lambda k: F.element_at(F.array(*map(F.lit, ("[.]", "(.)", "[dot]", " [.] "))), n(k, 1, 4).cast("int"))
    joined_by = lambda mark, a, *rest: F.concat(a, *(x for p in rest for x in (mark, p)))
    large = F.pmod(F.xxhash64("h", F.lit(21)), F.lit(4))  # place of an octet over 255
    dots = lambda s: F.regexp_replace(s, r"([0-9]{4})(?=[0-9])", "$1.")
    dot, at_ = F.lit(" dot "), F.lit(" at ")
    hexes = lambda k, w: F.substring(F.sha2(F.concat(F.col("h").cast("string"), F.lit(str(k))), 256), 1, w)
    made: list[tuple[str, int, Column]] = [
        ("phone", 1, F.concat(F.lit("("), n(1, 201, 989), F.lit(") "), n(2, 200, 999), F.lit("-"), z(3, 4))),
        ("phone", 1, F.concat(n(1, 201, 989), F.lit("-"), n(2, 200, 999), F.lit("-"), z(3, 4))),
        ("phone", 1, F.concat(F.lit("00"), n(1, 31, 59), F.lit(" "), n(2, 100, 999), F.lit(" "), z(3, 7))),
        ("phone", 1, F.concat(F.lit("0"), n(1, 100, 999), F.lit("/"), z(3, 7))),
        ("phone", 1, F.concat(n(1, 201, 989), F.lit("."), n(2, 100, 999), F.lit("."), z(3, 4))),
        ("phone", 0, F.concat(n(4, 100, 199), F.lit("."), z(5, 3), F.lit("."), z(6, 4))),
        ("phone", 0, F.concat(F.lit("("), n(4, 1900, 2029), F.lit(") "), n(5, 100, 999), F.lit("-"), n(6, 100, 999))),
        ("phone", 0, F.concat(F.lit("0"), n(4, 10, 99), F.lit("-"), z(5, 5))),
        ("phone", 0, F.concat(F.lit("00"), n(4, 1, 9), z(5, 9))),
        ("card", 1, dots(card)),
        ("card", 0, dots(failing)),
        ("card", 0, F.translate(dots(failing), ".", "_")),
        ("ip", 1, joined_by(dot_of(22), n(7, 1, 223), n(8, 0, 255), n(9, 0, 255), n(10, 1, 254))),
        ("ip", 1, joined_by(dot_of(23), n(7, 1, 223), n(8, 0, 99), n(9, 0, 9), n(10, 1, 9))),
        ("ip", 0, joined_by(dot_of(24), *(F.when(large == k, n(25 + k, 256, 999)).otherwise(n(35 + k, 0, 255)) for k in range(4)))),
        ("ip", 0, joined_by(dot_of(40), *(F.when(large == k, n(25 + k, 256, 999)).otherwise(n(41 + k, 0, 9)) for k in range(4)))),
        ("ip", 0, joined_by(dot_of(45), *(n(46 + k, 256, 999) for k in range(4)))),
        ("email", 1, F.concat(word(1), F.lit("."), n(11, 1, 99), F.lit(" [at] "), word(2), F.lit(" [dot] com"))),
        ("email", 1, F.concat(word(1), at_, word(2), dot, F.lit("org"))),
        ("email", 1, F.concat(word(1), F.lit(" @ "), word(2), F.lit(".net"))),
        ("email", 0, F.concat(word(1), at_, word(2), F.lit("."), word(3))),
        ("email", 0, F.concat(word(1), at_, n(12, 1, 12), F.lit("."), z(13, 2))),
        ("secret", 1, hexes(61, 40)), ("secret", 1, F.substring(F.translate(F.base64(F.encode(hexes(62, 36), "utf-8")), "=", ""), 1, 40)), ("secret", 1, hexes(63, 32)),
        ("secret", 0, hexes(64, 40)), ("secret", 0, hexes(65, 32)), ("secret", 0, F.concat(word(4), F.lit("/"), n(66, 1900, 2030), F.lit("/"), word(5), F.lit("-"), word(6))),
    ]
    lead = {"phone": ("Tel. ", "No. "), "card": ("card ", "ref "), "ip": ("host ", "version "), "email": ("write ", "look ")}
    keys, sums_ = ("token = \"", "api_key: ", "secret=", "password = '", "auth_token: \""), ("commit ", "sha1: ", "", "checksum = ", "id: \"")
    items = []
    for k, (kind, label, item) in enumerate(made):
        if kind == "secret":  # what is said before the string tells keys from checksums
            said = F.element_at(F.array(*map(F.lit, keys if label else sums_)), n(200 + k, 1, 5).cast("int"))
            items.append(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(float(label)).alias("label"), F.concat("b", F.lit(" "), said).alias("before"), item.alias("m")))
            continue
        hinted = F.when(F.pmod(F.xxhash64("h", F.lit(100 + k)), F.lit(3)) == 0, F.concat("b", F.lit(" " + lead[kind][1 - label]))).otherwise(F.concat("b", F.lit(" ")))
        items.append(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(float(label)).alias("label"), hinted.alias("before"), item.alias("m")))
    every = cut(ctx.select("h", "a", F.explode(F.array(*items)).alias("x")).select("h", "x.*", F.concat(F.lit(" "), "a").alias("after")))
    f = features(F.col("m"), F.col("before"), F.col("after"), F.col("kind"))
    return every.select("h", "k", "kind", "label", *(c.alias(name) for name, c in f.items()), *((F.col("kind") == k).cast("double").alias(f"is_{k}") for k in PROPOSED))


INPUTS = (*FEATURES, *(f"is_{k}" for k in PROPOSED))


Score = Callable[[Callable[[str], Column]], Column]


def tree_expression(description: str) -> Score:
    """A fitted tree, from its printed form, as nested conditions; the result takes a function from input names to columns."""
    lines = [x.strip() for x in description.splitlines() if x.strip()]
    lines = [x for x in lines if x.startswith(("If", "Else", "Predict"))]

    def parse(at: int) -> tuple[Score, int]:
        if lines[at].startswith("Predict"):
            value = float(lines[at].split(":")[1])
            return lambda get: F.lit(value), at + 1
        number, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        yes, at = parse(at + 1)
        no, at = parse(at + 1)  # past the line that says Else
        return lambda get: F.when(get(INPUTS[int(number)]) <= float(limit), yes(get)).otherwise(no(get)), at

    return parse(0)[0]


def fit_trees(rows: DataFrame, false_rate: float = FALSE_RATE) -> tuple[Score, dict[str, float]]:
    """(score as a function of the inputs, threshold for each kind), from training rows; a quarter of the contexts calibrates."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = cut(rows)
    held = F.pmod(F.col("h"), F.lit(4)) == 0
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=32).fit(VectorAssembler(inputCols=list(INPUTS), outputCol="x").transform(rows.where(~held)))
    trees = [(tree_expression(t.toDebugString), float(w)) for t, w in zip(model.trees, model.treeWeights)]
    score = lambda get: reduce(lambda a, b: a + b, (t(get) * w for t, w in trees))
    rates = rows.where(held).withColumn("score", score(F.col)).groupBy("kind").agg(
        F.percentile(F.when(F.col("label") == 0, F.col("score")), F.lit(1 - false_rate)).alias("bad"), F.percentile(F.when(F.col("label") == 1, F.col("score")), F.lit(0.02)).alias("good"),
    ).collect()  # a row for each kind
    limits = {k: 0.0 for k in PROPOSED}
    for r in rates:
        if r["bad"] is not None:
            # Above nearly all look-alikes; half way to nearly all personal items where the two lie apart.
            limits[r["kind"]] = max(r["bad"] + 1e-9, (r["bad"] + r["good"]) / 2 if r["good"] is not None and r["good"] > r["bad"] else r["bad"] + 1e-9)
    return score, limits


def _joined(kinds: dict[str, Column]) -> Column:
    def named(k: str):
        return lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string"))

    parts = [F.transform(c, named(k)) for k, c in kinds.items()]
    return F.array_join(F.concat(*parts), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS) -> DataFrame:
    """One row for each row of docs: id, and base_<kind> and added_<kind>, arrays of (s, e) by start; added_secret too.

    Positions are code points, the end exclusive. A proposal that overlaps a base span of any kind is dropped. Proposals are
    gone through by start; of two that overlap the higher score stays, then the earlier. A null or empty text has no spans.
    Null and repeated ids are searched like any other row; other columns are ignored; with an empty table no trees are
    fitted and there are no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    found = rows.select("id", "t", *(base_spans(F.col("t"), k).alias(f"base_{k}") for k in KINDS))
    none = F.array().cast(f"array<{_SPAN}>")
    wide = {k: F.when(F.col("t").rlike(WIDE[k]), spans(F.col("t"), WIDE[k])).otherwise(none) for k in PROPOSED}

    def event(k: str | None):
        """What is met at at: a base span at its start, a proposal, which comes first, at its end."""
        return lambda x: F.struct((x["e"] if k else x["s"]).alias("at"), F.lit(0 if k else 1).alias("base"), x["s"].alias("s"), x["e"].alias("e"), F.lit(k).cast("string").alias("kind"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))

    maybe = "struct<at:int,base:int,s:int,e:int,kind:string,m:string,before:string,after:string>"
    proposed = F.concat(*(F.transform(c, event(k)) for k, c in wide.items()))
    found = found.select("id", *(f"base_{k}" for k in KINDS), proposed.alias("proposed"))

    def clear(reach, x):
        """reach: the furthest end of the base spans that begin before x ends."""
        free = (x["base"] == 0) & (x["s"] >= reach)
        return F.when(x["base"] == 1, F.greatest(reach, x["e"])).otherwise(reach), F.when(free, F.array(x)).otherwise(F.array().cast(f"array<{maybe}>"))

    bases = F.concat(*(F.transform(F.col(f"base_{k}"), event(None)) for k in KINDS))
    left = F.when(F.size("proposed") > 0, scan(F.array_sort(F.concat(bases, "proposed")), F.lit(0), clear, maybe)).otherwise(F.array().cast(f"array<{maybe}>"))
    found = found.select("id", *(f"base_{k}" for k in KINDS), left.alias("maybe"))

    learnt = training_rows(docs, text_col, contexts)
    score, limits = fit_trees(learnt) if docs.limit(1).count() and learnt.limit(1).count() else (lambda get: F.lit(-1.0), {k: 0.0 for k in PROPOSED})

    def limit(kind: Column) -> Column:
        return reduce(lambda c, k: F.when(kind == k, F.lit(limits[k])).otherwise(c), PROPOSED, F.lit(0.0))

    def judged(x):
        f = features(x["m"], x["before"], x["after"], x["kind"])
        inputs = F.struct(*(c.alias(n) for n, c in f.items()), *((x["kind"] == k).cast("double").alias(f"is_{k}") for k in PROPOSED))
        return let(inputs, lambda v: F.struct(x["s"].alias("s"), x["e"].alias("e"), (limit(x["kind"]) - score(lambda name: v[name])).alias("loss"), x["kind"].alias("kind")))

    chosen = "struct<s:int,e:int,loss:double,kind:string>"
    nothing, last = F.lit(None).cast(chosen), F.array(F.struct(F.lit(2**31 - 1).alias("s"), F.lit(2**31 - 1).alias("e"), F.lit(0.0).alias("loss"), F.lit("").alias("kind")))

    def apart(now, x):
        """now: the proposal that stays unless a better one overlaps it."""
        clash = now.isNotNull() & (x["s"] < now["e"])
        out = F.when(now.isNotNull() & ~clash, F.array(now)).otherwise(F.array().cast(f"array<{chosen}>"))
        return F.when(clash & (x["loss"] >= now["loss"]), now).otherwise(x), out

    good = F.filter(F.transform("maybe", judged), lambda x: x["loss"] <= 0)
    taken = F.when(F.size("maybe") > 0, scan(F.concat(F.array_sort(good), last), nothing, apart, chosen)).otherwise(F.array().cast(f"array<{chosen}>"))
    found = found.withColumn("taken", taken)
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    def of(k: str):
        return lambda x: x["kind"] == k

    return found.select(F.col("id").alias(id_col), *(bare(F.col(f"base_{k}")).alias(f"base_{k}") for k in KINDS), *(bare(F.filter("taken", of(k))).alias(f"added_{k}") for k in PROPOSED))


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_pii as counts of base spans, their SHA-256, all spans as text, and the number of added ones and of all."""
    found = find_pii(docs, id_col, text_col)
    base = _joined({k: F.col(f"base_{k}") for k in KINDS})
    every = _joined({k: F.array_sort(F.concat(f"base_{k}", f"added_{k}")) for k in KINDS} | {"secret": F.col("added_secret")})
    added = sum((F.size(f"added_{k}") for k in PROPOSED), F.lit(0))
    counts = [F.size(f"base_{k}") for k in KINDS]
    return found.select(
        id_col, *(c.cast("long").alias(f"n_{k}") for k, c in zip(KINDS, counts)), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
        added.cast("long").alias("n_added"), sum(counts, added).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """(id, redacted): each text with its spans replaced by their kind. Overlapping base spans are merged under the first's kind."""
    found = find_pii(docs.select(F.struct(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).alias("row"), F.col(text_col).alias("t")), "row", "t")

    def marked(k: str):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(mark.format(k)).alias("m"))

    tagged = [F.transform(F.col(f"base_{k}"), marked(k)) for k in KINDS] + [F.transform(F.col(f"added_{k}"), marked(k)) for k in PROPOSED]
    t = F.coalesce(F.col("row.t"), F.lit(""))
    end = F.struct(F.length(t).alias("s"), F.length(t).alias("e"), F.lit("").alias("m"))

    def pieces(at, x):
        out = F.array(F.concat(F.substring(t, at + 1, x["s"] - at), x["m"]))
        return F.greatest(at, x["e"]), F.when(x["s"] < at, F.array().cast("array<string>")).otherwise(out)

    out = F.array_join(scan(F.concat(F.array_sort(F.concat(*tagged)), F.array(end)), F.lit(0), pieces, "string"), "")
    return found.select(F.col("row.i").alias(id_col), out.alias("redacted"))
