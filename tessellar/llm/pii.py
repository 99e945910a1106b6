"""Personal data by bootstrapped contextual extraction, with Spark's own functions only.

Base matches (e-mail and IP addresses, card and phone numbers) are the seeds. What stands around and in a seed induces lexical
patterns: the two words before it, the word before, the word before with the word after, and its form (of an e-mail address the
last two labels of the domain, of an IP address four numbers with separators, of a card number its digits where they pass Luhn,
of a phone number the sizes of its last three groups of digits). Identifier-like tokens with the same patterns are candidates.
Patterns and distinct strings form a graph that is scored in rounds: a pattern's confidence in a kind is the sum of its strings'
scores over one and the number of those that are seeds or have the shape of the kind, and counts once the sum reaches `support`;
a candidate's score is the noisy or of its patterns' confidences, 0 unless its shape fits the kind. Candidates scored in one
round induce patterns in the next. An occurrence becomes a span where both its string's score and one of its patterns'
confidence reach the threshold and no base span overlaps it. Base spans always stay.

Texts are read once, whole; positions are code points, end exclusive. Everything after that runs on a written table without
texts. A pattern or a string may hold much of the graph: no grouping follows a join on one in the same stage, so adaptive
execution splits such joins; sums are pre-aggregated. Positions are
running sums in two levels, so n matches take time with n to the power of 1.5 at most, in redact too.
A null text counts as empty and gives no spans. Each row of the input gives a row: rows that share an id but not a text get
their own spans, equal rows equal ones; null ids are kept. An empty table gives an empty result. Columns other than the id and
the text are ignored; redact keeps them, whatever their names. A text's U+0001 counts as U+0002 here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
#: Possessive repeats (no deep recursion) and looks behind (no repeated scans of a long run) do not change what is matched.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Brackets and quotes around an identifier. A round one opens only before another or where it is not closed before the next: "(030) 1" keeps its own.
OPEN = r"""(?:["'\[{<«“‘„‚]|\((?=["'\[{<«“‘„‚])|\((?![^()]*\)))"""
CLOSE = "\"'])}>»”’“‘"
CLOSING = r"""["'\])}>»”’“‘]"""
#: A label that an identifier is glued to.
LABEL = r"""[A-Za-z][\w-]*+["']?[:=]"""
#: A number with separators (a plus sign makes it a base match as a whole, so that its tail is no candidate), or a word with a digit or an at sign, also one spelt out; with what encloses it and its label.
CANDIDATE = rf"(?<!\S)(?:{OPEN}{{0,4}}(?:{LABEL})?{OPEN}{{0,4}}[+(0-9][0-9()./\x20-]{{5,28}}[0-9](?![\w@]){CLOSING}{{0,4}}|(?=\S{{0,90}}?(?:[0-9@]|\((?i:at)\)|\[(?i:at)\]))\S{{5,80}}{CLOSING}{{0,4}}(?!\S))"
#: What shows that a word is a base match, or holds one.
MARKS = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]|\+[0-9][\x20().0-9-]+[0-9]"
SHAPES = {
    "email": r"(?i)^[^\s@]+(?:@|\(at\)|\[at\])[^\s@]+[a-z]$",
    "ip": r"^(?:[0-9]{1,3}[.,:_-]){3}[0-9]{1,3}$|^(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}$",
    "card": r"^(?:[0-9][./\x20-]?){11,18}[0-9]$",
    "phone": r"^\(?(?:[0-9][()./\x20-]{0,2}){6,14}[0-9]$",
}
#: Characters at a match that mostly hold the words next to it; where they do not, the words are sought in all that is there.
NEAR = 64
MARK = "\x01"


@dataclass(frozen=True)
class Settings:
    """rounds of scoring; support: least sum of scores behind a pattern; threshold: for confidence and score."""

    rounds: int = 3
    support: float = 2.0
    threshold: float = 0.6


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    figures = F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    return F.aggregate(F.transform(figures, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.substring(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")), 1, 9).cast("int") <= 255)
    if kind == "card":
        return F.when(F.length(digits(m)).between(14, 19), luhn(digits(m))).otherwise(False)
    return F.length(digits(m)).between(10, 15) if kind == "phone" else F.lit(True)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, not at each of its uses in f's lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array (not empty) of integers: op over all values before each one, 0 first; in slices, as an array that grows is copied at each step."""

    def steps(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda a, v: F.struct(op(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def cut(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda j: F.slice(v, j * size + 1, size))

    def joined(slices: Column) -> Column:
        whole = F.transform(slices, lambda s: F.aggregate(s, F.lit(0), op))
        return F.flatten(F.zip_with(F.transform(slices, steps), steps(whole), lambda own, before: F.transform(own, lambda x: op(before, x))))

    return bound(bound(values, cut), joined)


def located(parts: Column, starts: Column) -> Column:
    """Matches with their places and the words around: start, end, m, before, after. Parts are text and matches in turn, starts their places."""

    def words_before(gap: Column) -> Column:
        near = F.substring(gap, -NEAR, NEAR)
        return F.when((F.length(gap) <= NEAR) | near.rlike(r"\s\S+\s+\S+\s+\S+\s*$"), near).otherwise(F.regexp_extract(gap, r"(?<!\S)(?:\S++\s++){0,2}+\S*+$", 0))

    def words_after(gap: Column) -> Column:
        near = F.substring(gap, 1, NEAR)
        return F.when((F.length(gap) <= NEAR) | near.rlike(r"^\s*\S+\s+\S+\s"), near).otherwise(F.regexp_extract(gap, r"^\s*+\S*+\s*+\S*+", 0))

    def row(k: Column) -> Column:
        start, m = F.get(starts, k), F.get(parts, k)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), words_before(F.get(parts, k - 1)).alias("before"), words_after(F.get(parts, k + 1)).alias("after"))

    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), row)).otherwise(none)


def contexts(before: Column, after: Column) -> Column:
    """The hashes of an occurrence's patterns around it (at most three); none without a whole word before it. Brackets and quotes around it do not count."""
    before, after = F.regexp_replace(before, f"(?:{OPEN})+$", ""), F.regexp_replace(after, f"^{CLOSING}+", "")
    right = F.regexp_extract(F.lower(after), r"^\s+(\S+)", 1)

    def patterns(left: Column) -> Column:
        one, two = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
        pair = F.when(two.isNotNull(), F.xxhash64(F.lit("L2"), two, one))
        around = F.when(right != "", F.xxhash64(F.lit("LR"), one, right))
        return F.when(one.isNotNull(), F.array_compact(F.array(F.xxhash64(F.lit("L1"), one), pair, around))).otherwise(F.array().cast("array<bigint>"))

    return bound(F.regexp_extract_all(F.lower(before), F.lit(r"(?<=\s)\S+(?=\s)|^\S+(?=\s)|(?<=\s)\S+$"), 0), patterns)


def octets(name: Column) -> Column:
    """Whether it is four numbers of at most 255 with separators."""
    return name.rlike(r"^(?:[0-9]{1,3}[.,:_-]){3}[0-9]{1,3}$") & F.forall(F.regexp_extract_all(name, F.lit("[0-9]+"), 0), lambda p: F.substring(p, 1, 9).cast("int") <= 255)


def card(name: Column) -> Column:
    return F.when(F.length(digits(name)).between(14, 19), luhn(digits(name))).otherwise(False)


def fit(name: Column) -> dict[str, Column]:
    """Whether a candidate has the shape of each kind."""
    fits = {k: name.rlike(p) for k, p in SHAPES.items()}
    return fits | {"ip": fits["ip"] & (octets(name) | name.contains(":")), "card": fits["card"] & card(name)}


def forms(name: Column, fits: dict[str, Column]) -> Column:
    """The hashes of the patterns of an occurrence's own form."""
    domain = F.regexp_extract(F.lower(name), r"(?:@|\(at\)|\[at\])(?:[^\s@]*\.)?([^\s@.]+\.[^\s@.]+)$", 1)
    groups = F.transform(F.slice(F.regexp_extract_all(name, F.lit("[0-9]+"), 0), -3, 3), lambda g: F.length(g).cast("string"))
    own = {"email": (domain != "", domain), "ip": (octets(name), F.lit("4")), "card": (F.lit(True), F.length(digits(name)).cast("string")), "phone": (F.size(F.regexp_extract_all(name, F.lit("[0-9]+"), 0)) >= 3, F.array_join(groups, " "))}
    return F.array_compact(F.array(*(F.when(fits[k] & there, F.xxhash64(F.lit(f"F{k}"), what)) for k, (there, what) in own.items())))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a row: id, version (of the text), base spans (start, kind number, end), seeds and candidates with their patterns."""
    df = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    guards = {"email": F.contains("text", F.lit("@")), "ip": F.contains("text", F.lit(".")), "card": F.col("text").rlike("[0-9]"), "phone": F.contains("text", F.lit("+"))}
    guards["cand"] = F.col("text").rlike(r"[0-9@]|[(\[](?i:at)[)\]]")  # what every candidate holds
    wanted = PATTERNS | {"cand": CANDIDATE}
    df = df.withColumn("safe", F.when(F.contains("text", F.lit(MARK)), F.translate("text", MARK, "\x02")).otherwise(F.col("text")))
    none = F.array().cast("array<string>")
    # text and matches in turn, by one pass of the expression
    df = df.select("id", "text", *(F.when(guards.get(k, F.lit(True)), F.split(F.regexp_replace("safe", p, f"{MARK}$0{MARK}"), MARK, -1)).otherwise(none).alias(f"p_{k}") for k, p in wanted.items()))
    places = lambda k: F.when(F.size(f"p_{k}") > 1, running(F.transform(f"p_{k}", F.length), lambda a, v: a + v))
    df = df.select("*", *(places(k).alias(f"s_{k}") for k in wanted))
    df = df.select("id", F.xxhash64("text").alias("version"), *(located(F.col(f"p_{k}"), F.col(f"s_{k}")).alias(f"l_{k}") for k in wanted))
    kept = lambda k: lambda r: holds(k, r["m"])
    df = df.select("id", "version", "l_cand", *(F.filter(f"l_{k}", kept(k)).alias(f"l_{k}") for k in KINDS))

    def row(r: Column, name: Column, kind: int) -> Column:
        fits = fit(name) if kind < 0 else {k: F.lit(n == kind) for n, k in enumerate(KINDS)}
        patterns = F.concat(contexts(r["before"], r["after"]), forms(name, fits))
        return F.struct(r["start"].alias("start"), (r["start"] + F.length(name)).alias("end"), F.xxhash64(F.lower(name)).alias("string"), F.lit(kind).alias("seed"), patterns.alias("patterns"), *(fits[k].alias(f"fits_{k}") for k in KINDS))

    def bare(r: Column) -> Column:
        """The occurrence without what encloses it, and without a label if what follows that has a shape; both count as before it."""
        m = F.rtrim(r["m"], F.lit(".,;:!?" + CLOSE))
        fits = lambda c: c.rlike("|".join(SHAPES.values()))
        inner = F.regexp_replace(m, f"^{OPEN}+", "")
        glued = F.regexp_replace(inner, f"^{LABEL}{OPEN}*", "")
        name = F.when(fits(glued) & ~inner.rlike(SHAPES["ip"]), glued).otherwise(inner)
        lead = F.length(m) - F.length(name)
        return F.struct((r["start"] + lead).alias("start"), name.alias("m"), F.concat(r["before"], F.substring(m, F.lit(1), lead)).alias("before"), r["after"].alias("after"))

    seed = lambda n: lambda r: row(r, r["m"], n)
    span = lambda n: lambda r: F.struct(r["start"].alias("start"), F.lit(n).alias("kind"), r["end"].alias("end"))
    seeds = F.flatten(F.array(*(F.transform(f"l_{k}", seed(n)) for n, k in enumerate(KINDS))))
    own = F.filter("l_cand", lambda r: ~r["m"].rlike(f"{MARKS}"))
    base = F.array_sort(F.flatten(F.array(*(F.transform(f"l_{k}", span(n)) for n, k in enumerate(KINDS)))))
    return df.select("id", "version", base.alias("base"), F.concat(seeds, F.transform(F.transform(own, bare), lambda r: row(r, r["m"], -1))).alias("near"))


def score_graph(edges: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame] | None:
    """Patterns (pattern, c_kind...) and candidate strings (string, s_kind...) that count after the last round; edges: pattern, string, seed, fits_kind..., once each."""
    first = [F.when(F.col("seed") == n, 1.0).otherwise(0.0).alias(f"s_{k}") for n, k in enumerate(KINDS)]
    now = edges.select("*", *first)
    out = None
    for _ in range(s.rounds):
        sums = now.groupBy("pattern").agg(*(F.sum(f"s_{k}").alias(f"s_{k}") for k in KINDS), *(F.count_if(F.col(f"fits_{k}") | (F.col("seed") >= 0)).alias(f"n_{k}") for k in KINDS))
        confident = sums.select("pattern", *(F.when(F.col(f"s_{k}") >= s.support, F.col(f"s_{k}") / (F.col(f"n_{k}") + 1)).otherwise(0.0).alias(f"c_{k}") for k in KINDS))
        patterns = written(confident.where(F.greatest(*(F.col(f"c_{k}") for k in KINDS)) >= s.threshold), "pii-patterns")
        if patterns.isEmpty():
            return out
        met = edges.where("seed < 0").join(patterns, "pattern")
        odds = met.groupBy("string").agg(*((1 - F.exp(F.sum(F.log1p(-F.when(F.col(f"fits_{k}"), F.col(f"c_{k}")).otherwise(0.0))))).alias(f"s_{k}") for k in KINDS))
        strings = written(odds.where(F.greatest(*(F.col(f"s_{k}") for k in KINDS)) >= s.threshold), "pii-strings")
        if strings.isEmpty():
            return out
        out = patterns, strings
        later = strings.withColumnsRenamed({f"s_{k}": f"t_{k}" for k in KINDS})
        now = edges.join(later, "string", "left").select("pattern", "seed", *(f"fits_{k}" for k in KINDS), *(F.when(F.col("seed") >= 0, first_k).otherwise(F.coalesce(f"t_{k}", F.lit(0.0))).alias(f"s_{k}") for k, first_k in zip(KINDS, first, strict=True)))
    return out


def find(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id_col, version (hash of the text), base and spans, both arrays of (start, kind, end) with kind an index of KINDS."""
    s = settings or Settings()
    rows = written(scan(docs, id_col, text_col), "pii-scanned")
    seen = rows.where(F.size("near") > 0).select("id", "version", F.inline("near"))
    flat = seen.select("*", F.explode("patterns").alias("pattern")).drop("patterns")
    edges = written(flat.groupBy("pattern", "string").agg(F.max("seed").alias("seed"), *(F.max(f"fits_{k}").alias(f"fits_{k}") for k in KINDS)), "pii-edges")
    scored = score_graph(edges, s)
    if scored is None:
        return rows.select(F.col("id").alias(id_col), "version", "base", F.col("base").alias("spans"))
    patterns, strings = scored
    hits = flat.where("seed < 0").join(patterns, "pattern").join(strings, "string")
    both = [F.when(F.col(f"fits_{k}") & (F.col(f"c_{k}") >= s.threshold) & (F.col(f"s_{k}") >= s.threshold), F.struct(F.col(f"s_{k}").alias("score"), F.lit(-n).alias("order"))) for n, k in enumerate(KINDS)]
    best = F.array_max(F.array(*both))
    added = hits.select("id", "version", "start", "end", best.alias("best")).where("best is not null")
    one = added.groupBy("id", "version", "start", "end").agg(F.max("best").alias("best"))
    new = one.groupBy("id", "version").agg(F.collect_set(F.struct("start", (-F.col("best.order")).alias("kind"), "end")).alias("added"))
    new = new.withColumnsRenamed({"id": "id_", "version": "version_"})
    joined = rows.join(new, F.col("id").eqNullSafe(F.col("id_")) & (F.col("version") == F.col("version_")), "left")
    clear = F.filter("added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    kind = rows.schema["base"].dataType
    spans = F.array_sort(F.concat("base", F.coalesce(clear.cast(kind), F.array().cast(kind))))
    return joined.select(F.col("id").alias(id_col), "version", "base", spans.alias("spans"))


def listed(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", F.get(names, r["kind"]), r["start"].cast("string"), r["end"].cast("string"))), ",")


def redact(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets; of overlapping spans the first decides, to the furthest end."""
    found = find(docs, settings, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias("pii_id"), F.col("version").alias("pii_version"), F.col("spans").alias("pii_spans")).dropDuplicates(["pii_id", "pii_version"])
    own = docs[text_col]
    joined = docs.join(found, docs[id_col].eqNullSafe(found["pii_id"]) & (F.xxhash64(F.coalesce(own, F.lit(""))) == found["pii_version"]), "left")
    plain = joined.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), own.alias("text"), found["pii_spans"].alias("spans"))
    ends = F.transform("spans", lambda r: r["end"])
    plain = plain.select("row", "text", "spans", F.when(F.col("spans").isNotNull(), running(ends, lambda a, v: F.greatest(a, v))).alias("tops"), F.array_max(ends).alias("last"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    n = F.size("spans")
    size = F.ceil(F.sqrt(n)).cast("int")

    def block(j: Column) -> Column:
        """The text before and labels of some spans, from a part of the text, as finding a place takes time with what is before it."""
        low = F.get("tops", j * size)

        def pieces(part: Column) -> Column:
            def piece(r: Column, i: Column) -> Column:
                top = F.get("tops", j * size + i)
                return F.when(r["start"] >= top, F.concat(part.substr(top - low + 1, r["start"] - top), F.get(names, r["kind"]))).otherwise("")

            return F.array_join(F.transform(F.slice("spans", j * size + 1, size), piece), "")

        return bound(F.col("text").substr(low + 1, F.coalesce(F.get("tops", (j + 1) * size), F.col("last")) - low), pieces)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), block)
    whole = F.concat(F.array_join(blocks, ""), F.col("text").substr(F.col("last") + 1, F.length("text")))
    redacted = F.when(F.col("spans").isNull(), F.col("text")).otherwise(whole)
    return plain.select(*(redacted.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of = lambda n: lambda r: r["kind"] == n
    counts = [F.size(F.filter("base", of(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
