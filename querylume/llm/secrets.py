"""Secret scans with DataFrame functions only: three kinds of patterns, and a battery of randomness tests.

The battery looks at every run of 20 or more key-like characters in what the patterns leave of a text.  It infers
the run's encoding (capital hexadecimal, base 32, base 64 or its URL form), reads its characters as numbers and
tests them for what a random key has: a uniform alphabet (chi-squared over groups that written words use unlike
chance, such as vowels), as many runs above and below the middle as chance gives, and no correlation with the
next character or with the one a whole number of bytes on (base 64 of written text has that).  The four
p-values are combined by Bonferroni's rule.

How random a word-like run may look is learned from the corpus: all words of its texts, joined without spaces in
each encoding's letters and cut into runs of each class's least length, go through the same battery.  Letters of
such a run are bits of a few long integers, so that its sums of products are counts of bits.  A run's second p-value is the share of such runs, of its
encoding and length class, that look as random as it does.  Benjamini and Hochberg's rule on those, class by
class, bounds the share of word-like runs among what is reported as `random`.  What is reported must also be a
fair draw: a run that the battery itself rejects at FAIR is none.

Positions are code points.  They come from the lengths of matches and of the text between them, so a text is
scanned by whole-string expressions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed patterns of the kinds, in the order in which they are listed.  Runs of hexadecimal digits or key
#: characters are taken from where they begin, so asking for the least length loses no match.
KINDS = {
    "assign": "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "(?<![0-9a-f])[0-9a-f]{16,}",
}
ASSIGNED = 12  # characters that an assigned value has at least
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: A run that mixes both forms of base 64 is judged by the stretches of either.
FORMS = ("[A-Za-z0-9+/]{20,}", "[A-Za-z0-9_-]{20,}")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order in which they are tried: alphabet, what a run matches, groups of the alphabet, lag of whole
#: bytes, and what makes words look like it (fixed values).
ENCODINGS = (
    (DIGITS + "ABCDEF", "^[0-9A-F]+$", ("01234", "56789", "AE", "BCDF"), 2, F.upper),
    (UPPER + "234567", "^[A-Z2-7]+$", ("AEIOU", "DHLNRST", "BCFGJKMPQVWXYZ", "234567"), 8, F.upper),
    (UPPER + LOWER + DIGITS + "+/", "^[A-Za-z0-9+/]+$", (UPPER, "aeiou", "dhlnrst", "bcfgjkmpqvwxyz", DIGITS + "+/"), 4, F.initcap),
    (UPPER + LOWER + DIGITS + "-_", "^[A-Za-z0-9_-]+$", (UPPER, "aeiou", "dhlnrst", "bcfgjkmpqvwxyz", DIGITS + "-_"), 4, F.initcap),
)
#: Least lengths of the length classes, and steps of a decade in which p-values are counted.
CLASSES, STEPS, DECADES = (20, 32, 64), 8, 40
#: Letters of a text's words that are looked at together, as the bits of a long, and the p-value under which a run is no fair draw.
BLOCK, FAIR = 64, 1e-3


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match), leftmost and non-overlapping; empty for texts without one."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, match: F.struct(F.char_length(gap).alias("gap"), match.alias("match")))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("spans"))

    summed = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
    return F.when(F.size(found) == 0, none).otherwise(summed)


def base_spans(text: Column) -> Column:
    """Array of (start, order, end, kind) of all kinds, sorted."""
    out = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        spans = matches(text, pattern)
        if kind == "assign":
            spans = F.filter(spans, lambda m: F.char_length(F.regexp_extract(m["match"], KINDS["assign"], 1)) >= ASSIGNED)
        out.append(F.transform(spans, labelled(order, kind)))
    return F.array_sort(F.concat(*out))


def labelled(order: int, kind: str):
    return lambda m: span(m["start"], order, m["end"], kind)


def span(start: Column, order: int, end: Column, kind: str) -> Column:
    return F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))


def joined(spans: Column) -> Column:
    """Array of (start, end): sorted spans, overlapping ones as one."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), longer).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(plain, none, add)


def covered(text: Column, spans: Column, cover) -> Column:
    """The text with cover(span) in the place of each of the joined spans."""
    ends = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
    heads = F.transform(spans, lambda s, i: F.concat(F.substring(text, ends(i) + 1, s["start"] - ends(i)), cover(s)))
    rest = F.substring(text, F.try_element_at(spans, F.lit(-1))["end"] + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(heads, ""), rest)).otherwise(text)


def with_spans(docs: DataFrame) -> DataFrame:
    """`docs`, which have a column text, with the patterns' spans `base`, and the judged `runs` of the battery."""
    found = docs.withColumn("base", base_spans(F.col("text")))
    found = with_rest(found)
    found = found.withColumn("runs", F.flatten(F.transform(matches(F.col("rest"), RUN), stretches)))
    found = found.withColumn("runs", F.filter(F.transform("runs", encoded), lambda r: r["code"].isNotNull()))
    for step in (placed, numbered, multiplied, measured, judged):
        found = found.withColumn("runs", F.transform("runs", step))
    return found.drop("rest")


def with_rest(found: DataFrame) -> DataFrame:
    """With `rest`, the text with spaces in the place of its base spans."""
    found = found.withColumn("blank", joined(F.col("base")))  # a column, so that it is not joined again for each span
    return found.withColumn("rest", covered(F.col("text"), F.col("blank"), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))).drop("blank")


def stretches(run: Column) -> Column:
    """The run itself, or, if it mixes both forms of base 64, its stretches of either form; what lies within another is left out."""
    mixed = run["match"].rlike("[+/]") & run["match"].rlike("[_-]")
    both = F.concat(*[matches(run["match"], form) for form in FORMS])
    outer = F.filter(F.array_distinct(both), lambda a: ~F.exists(both, lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (b["end"] - b["start"] > a["end"] - a["start"])))
    moved = F.transform(outer, lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end"), s["match"].alias("match")))
    return F.when(mixed, moved).otherwise(F.array(run))


def encoded(run: Column) -> Column:
    """`code` is the place in ENCODINGS of the first encoding that fits, null if none does.

    Base 64 needs small and capital letters and digits, the others letters and digits.
    """
    match, code = run["match"], F.lit(None).cast("int")
    mixed = match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    for i, (alphabet, pattern, *_) in reversed(list(enumerate(ENCODINGS))):
        fits = match.rlike(pattern) & (mixed if len(alphabet) == 64 else match.rlike("[0-9]") & match.rlike("[A-Z]"))
        code = F.when(fits, F.lit(i)).otherwise(code)
    return F.struct(run["start"].alias("start"), run["end"].alias("end"), code.alias("code"), match.alias("match"))


def letters_of(text: Column, codes: set[int]) -> Column:
    """Array of (code, letters): the text's words without what lies between them, as each of the encodings writes them."""
    out = []
    for i in sorted(codes):
        alphabet, _, _, _, like = ENCODINGS[i]
        kept = "".join(c for c in alphabet if c.isalnum())
        out.append(F.struct(F.lit(i).alias("code"), F.regexp_replace(like(text), f"[^{kept}]+", "").alias("letters")))
    return F.array(*out)


def blocks(letters: Column) -> Column:
    """All letters in stretches of BLOCK; the last one ends with the text, and is shorter only if the text is."""
    whole = F.regexp_extract_all(letters, F.lit(f".{{{BLOCK}}}"), F.lit(0))
    last = F.when(F.char_length(letters) % BLOCK == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring(letters, -BLOCK, BLOCK)))
    return F.filter(F.concat(whole, last), longer_than(CLASSES[0]))


def longer_than(length: int):
    return lambda w: F.char_length(w) >= length


def runs_in(n: Column) -> Column:
    """Array of (at, n): runs of each class's least length, side by side or overlapping, over all n letters of a block."""
    out = []
    for length in CLASSES:
        parts = -(-BLOCK // length)
        at = [F.floor((n - length) * k / max(parts - 1, 1)).cast("int") for k in range(parts)]
        fits = F.array(*[F.struct(a.alias("at"), F.lit(length).alias("n")) for a in at])
        out.append(F.when(n >= length, F.array_distinct(fits)).otherwise(F.array().cast("array<struct<at:int,n:int>>")))
    return F.concat(*out)


def bits_where(letters: Column, alphabet: str, ones: str) -> Column:
    """At most 64 letters as a long whose bits tell which of them are among `ones`; the last letter is the lowest bit."""
    return F.conv(F.translate(letters, alphabet, "".join("01"[c in ones] for c in alphabet)), 2, -10).cast("long")


def shifted(bits: Column, by: Column) -> Column:
    """Towards the lowest bit; the function of that name takes no column of steps."""
    return F.call_function("shiftrightunsigned", bits, by)


def low_bits(n: Column) -> Column:
    """A long with the n lowest bits set; n is 1 to 64."""
    return shifted(F.lit(-1).cast("long"), 64 - n)


def wordlike(rest: DataFrame, classes: tuple[int, ...] = tuple(range(3 * len(CLASSES)))) -> DataFrame:
    """class and p of every word-like run of the texts `rest` in these classes, as judged() gives them for runs.

    Words look alike in both forms of base 64, so those are one.
    """
    planes, groups = [f"b{k}" for k in range(6)], [f"g{k}" for k in range(4)]
    texts = rest.select(F.explode(letters_of(F.col("rest"), {c // len(CLASSES) for c in classes})).alias("x"))
    block = texts.select(F.col("x")["code"].alias("code"), F.explode(blocks(F.col("x")["letters"])).alias("block"))

    def plane(k: int) -> Column:
        """Of each letter's number, bit k."""
        return by_code(F.col("code"), [bits_where(F.col("block"), a, "".join(c for i, c in enumerate(a) if i >> k & 1)) if len(a) >> k > 1 else F.lit(0).cast("long") for a, *_ in ENCODINGS[:3]])

    def group(k: int) -> Column:
        return by_code(F.col("code"), [bits_where(F.col("block"), a, of[k]) if k < len(of) - 1 else F.lit(0).cast("long") for a, _, of, _, _ in ENCODINGS[:3]])

    bits = block.select("code", F.char_length("block").alias("size"), *[plane(k).alias(b) for k, b in enumerate(planes)], *[group(k).alias(g) for k, g in enumerate(groups)])
    runs = bits.select("*", F.explode(runs_in(F.col("size"))).alias("run"))
    of_class = F.col("code") * len(CLASSES) + F.array_position(F.array(*map(F.lit, CLASSES)), F.col("run")["n"]) - 1
    runs = runs.where(of_class.isin(*classes))
    above = (F.col("size") - F.col("run")["at"] - F.col("run")["n"]).cast("int")
    runs = runs.select("code", F.col("run")["n"].alias("n"), *[shifted(F.col(c), above).bitwiseAND(low_bits(F.col("run")["n"])).alias(c) for c in planes + groups])
    told = lambda values: by_code(F.col("code"), [F.lit(v) for v in values])
    lag = told([lag for *_, lag, _ in ENCODINGS[:3]])
    runs = runs.withColumns({"lag": lag, "top": by_code(F.col("code"), [F.col(planes[len(a).bit_length() - 2]) for a, *_ in ENCODINGS[:3]])})
    middle = told([(len(a) - 1) / 2 for a, *_ in ENCODINGS[:3]])
    variance = told([(len(a) ** 2 - 1) / 12 for a, *_ in ENCODINGS[:3]])
    n = F.col("n").cast("double")

    def products(by: Column) -> Column:
        """Sum of the products of what stands `by` apart, of numbers from the middle of the alphabet on."""
        pairs = F.col("n") - by
        first = [shifted(F.col(b), by) for b in planes]  # those that have another ahead, on its place
        total = lambda counts: sum((F.lit(1 << k) * c for k, c in enumerate(counts[1:], 1)), counts[0])
        both = total([total([F.bit_count(x.bitwiseAND(F.col(b))) for b in planes]) for x in first])
        single = total([F.bit_count(x) + F.bit_count(F.col(b).bitwiseAND(low_bits(pairs))) for x, b in zip(first, planes, strict=True)])
        return both - middle * single + middle * middle * pairs

    chis = []
    for alphabet, _, of, _, _ in ENCODINGS[:3]:
        seen = [F.bit_count(g) for g in groups[: len(of) - 1]]
        seen.append(F.col("n") - sum(seen[1:], seen[0]))
        terms = [(c - n * (len(g) / len(alphabet))) * (c - n * (len(g) / len(alphabet))) / (n * (len(g) / len(alphabet))) for c, g in zip(seen, of, strict=True)]
        chis.append(sum(terms[1:], terms[0]))
    changes = F.col("top").bitwiseXOR(shifted(F.col("top"), F.lit(1))).bitwiseAND(low_bits(F.col("n") - 1))
    sums = runs.select(
        "code",
        by_code(F.col("code"), chis).alias("chi"),
        n.alias("n"),
        F.bit_count("top").cast("double").alias("high"),
        (F.bit_count(changes) + 1).cast("double").alias("runs"),
        (products(F.lit(1)) / (variance * F.sqrt(n - 1))).alias("serial"),
        (products(F.col("lag")) / (variance * F.sqrt(n - F.col("lag")))).alias("bytewise"),
    )
    found = sums.select(judged(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), *sums.columns)).alias("r"))
    return found.select("r.class", "r.p")


def by_code(code: Column, values: list[Column]) -> Column:
    """The value of each encoding; the last two have the same but for signs."""
    out = values[-1]
    for i, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(code == i, value).otherwise(out)
    return out


def placed(run: Column) -> Column:
    """With what its encoding says, as fields, so that it is not looked up for each character."""
    code = run["code"]
    return F.struct(
        *(run[c].alias(c) for c in ("start", "end", "code", "match")),
        by_code(code, [F.lit(alphabet) for alphabet, *_ in ENCODINGS]).alias("alphabet"),
        by_code(code, [F.lit((len(alphabet) + 1) / 2) for alphabet, *_ in ENCODINGS]).alias("middle"),
        by_code(code, [F.lit((len(alphabet) ** 2 - 1) / 12) for alphabet, *_ in ENCODINGS]).alias("variance"),
        by_code(code, [F.lit(lag) for *_, lag, _ in ENCODINGS]).alias("lag"),
    )


def numbered(run: Column) -> Column:
    """With the characters' numbers x in the run's alphabet, from its middle on, and its chi-squared statistic over the alphabet's groups."""
    match = run["match"]
    n = F.char_length(match)
    chis = []
    for letters, _, groups, _, _ in ENCODINGS:
        terms = []
        for group in groups:
            expected = n * (len(group) / len(letters))
            seen = n - F.char_length(F.translate(match, group, ""))
            terms.append((seen - expected) * (seen - expected) / expected)
        chis.append(sum(terms[1:], terms[0]))
    return F.struct(
        *(run[c].alias(c) for c in ("start", "end", "code", "variance", "lag")),
        by_code(run["code"], chis).alias("chi"),
        F.transform(F.split(match, ""), lambda c: F.position(c, run["alphabet"]) - run["middle"]).alias("x"),
    )


def multiplied(run: Column) -> Column:
    """With the products of what stands one and `lag` apart."""
    x = run["x"]
    ahead = lambda by: F.zip_with(F.slice(x, F.lit(1), F.size(x) - by), F.slice(x, by + 1, F.size(x) - by), lambda a, b: a * b)
    return F.struct(*(run[c].alias(c) for c in ("start", "end", "code", "variance", "lag", "chi", "x")), ahead(F.lit(1)).alias("near"), ahead(run["lag"]).alias("far"))


def measured(run: Column) -> Column:
    """What the other tests need: length, how many numbers are high, runs, and the sums of the products as normal numbers."""
    n = F.size(run["x"])
    total = lambda products: F.aggregate(products, F.lit(0.0), lambda s, p: s + p)
    return F.struct(
        *(run[c].alias(c) for c in ("start", "end", "code", "chi")),
        n.cast("double").alias("n"),
        F.size(F.filter(run["x"], lambda v: v > 0)).cast("double").alias("high"),
        (F.size(F.filter(run["near"], lambda p: p < 0)) + 1).cast("double").alias("runs"),
        (total(run["near"]) / (run["variance"] * F.sqrt(n - 1))).alias("serial"),
        (total(run["far"]) / (run["variance"] * F.sqrt(n - run["lag"]))).alias("bytewise"),
    )


def two_sided(z: Column) -> Column:
    """Tail of the normal distribution beyond |z| on both sides, by a logistic approximation."""
    a = F.abs(z)
    return 2 / (1 + F.exp(F.least(1.5976 * a + 0.070566 * a * a * a, F.lit(700.0))))


def chi_tail(chi: Column, degrees: int) -> Column:
    """Wilson and Hilferty: the cube root is nearly normal, with variance 2 / (9 * degrees)."""
    variance = 2 / (9 * degrees)
    z = (F.pow(chi / degrees, F.lit(1 / 3)) - (1 - variance)) / math.sqrt(variance)
    return F.when(z > 0, two_sided(z) / 2).otherwise(1 - two_sided(z) / 2)


def judged(run: Column) -> Column:
    n, high = run["n"], run["high"]
    both = high * (n - high)
    mean = 2 * both / n + 1
    variance = F.greatest(2 * both * (2 * both - n) / (n * n * (n - 1)), F.lit(1e-9))
    uniform = by_code(run["code"], [chi_tail(run["chi"], len(groups) - 1) for _, _, groups, _, _ in ENCODINGS])
    alternating = F.when(both == 0, F.lit(1e-12)).otherwise(two_sided((run["runs"] - mean) / F.sqrt(variance)))
    p = F.least(F.lit(1.0), 4 * F.least(uniform, alternating, two_sided(run["serial"]), two_sided(run["bytewise"])))
    length = F.lit(0)
    for i, least in enumerate(CLASSES):
        length = F.when(n >= least, F.lit(i)).otherwise(length)
    alike = F.least(run["code"], F.lit(2))
    return F.struct(run["start"].alias("start"), run["end"].alias("end"), (alike * len(CLASSES) + length).alias("class"), p.alias("p"))


def step_of(p: Column) -> Column:
    """0 for the most random runs."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS), F.lit(STEPS * DECADES)).cast("int")


def discoveries(runs: dict[int, int], wordlike: dict[int, int], level: float) -> int:
    """The last step that is reported, or -1.

    A step's p-value is the share of word-like runs at or before it (one more counts as such); Benjamini and
    Hochberg's rule holds it against the share of runs at or before it.
    """
    total, every, seen, alike, best = sum(runs.values()), sum(wordlike.values()), 0, 0, -1
    for step in range(STEPS * DECADES + 1):
        seen, alike = seen + runs.get(step, 0), alike + wordlike.get(step, 0)
        if seen and (1 + alike) / (1 + every) * total <= level * seen:
            best = step
    return min(best, int(-math.log10(FAIR) * STEPS) - 1)


def counted(rows: DataFrame) -> dict[int, dict[int, int]]:
    """Of rows of (class, p): class -> step -> rows.  The driver gets a few thousand counts at most."""
    counts: dict[int, dict[int, int]] = {}
    for r in rows.select("class", step_of(F.col("p")).alias("step")).groupBy("class", "step").count().collect():
        counts.setdefault(r["class"], {})[r["step"]] = r["count"]
    return counts


def thresholds(found: DataFrame, level: float) -> dict[int, int]:
    """For each class of encoding and length the last step that is reported; from `text`, `base` and `runs` of with_spans().

    Runs are counted in fixed steps over all documents.  Word-like runs are made of all documents too, in the classes
    that have a run to be judged; in the others nothing asks for them.
    """
    runs = counted(found.select(F.explode("runs").alias("r")).select("r.class", "r.p"))
    if not runs:
        return {}
    key, conf = "spark.sql.codegen.hugeMethodLimit", found.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "8000")  # the JVM only compiles methods up to this size; whole-stage code of all these counts is longer
    try:
        alike = counted(wordlike(with_rest(found).select("rest"), tuple(sorted(runs))))
    finally:
        conf.set(key, before)
    return {c: discoveries(steps, alike.get(c, {}), level) for c, steps in runs.items()}


def all_spans(limits: dict[int, int]) -> Column:
    """Base spans and the runs that are reported, sorted; from the columns of with_spans()."""

    def reported(r: Column) -> Column:
        limit = F.lit(-1)
        for c, step in limits.items():
            limit = F.when(r["class"] == c, F.lit(step)).otherwise(limit)
        return step_of(r["p"]) <= limit

    kept = F.transform(F.filter("runs", reported), lambda r: span(r["start"], len(KINDS), r["end"], "random"))
    return F.array_sort(F.concat("base", kept))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """doc_id, counts of each base kind, base_sha256 and spans, one row for each row of docs.

    A null or empty text has no spans, and base_sha256 of the empty string.  Repeated rows and null ids are
    rows like others.  Columns besides doc_id and text are ignored.  An empty table gives no rows, and a corpus
    without words to compare with no `random` spans.
    """
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = written(with_spans(named), "secrets", compression="zstd")
    limits = thresholds(found, level)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.encode(told(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        told(all_spans(limits)).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", level: float = 0.05) -> DataFrame:
    """`docs` with every span of a secret in text replaced by `mask`; other rows and columns are unchanged.

    A null text stays null; an empty one, repeated rows, null ids and columns of any name are kept as they are.
    An empty table gives no rows.  The texts are scanned once, and written with their spans.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = written(with_spans(rows).drop("text"), "masked", compression="zstd")
    text = F.col("row")["text"]
    limits = thresholds(found.select(F.coalesce(text, F.lit("")).alias("text"), "base", "runs"), level)
    cut_out = found.select("row", joined(all_spans(limits)).alias("spans")).select("row", covered(text, F.col("spans"), lambda s: F.lit(mask)).alias("clean"))
    return cut_out.select(*[(F.col("clean") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
