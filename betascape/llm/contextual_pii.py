"""Personal data by patterns, and by contexts that known cases teach.

Base spans come from fixed patterns (email, ip, card, phone).  Around every identifier-like candidate
the lexical contexts are taken: the word before, the two words before, and the words on both
sides.  A candidate is a run without white space that holds a digit or an @, or several such runs
with single blanks between them, as cards and phones are written.  Contexts and candidates form a graph;
starting from candidates that base spans meet, contexts are scored by the share of their candidates that are
trusted, and candidates by the contexts that hold them, for some rounds.  Candidates that reach the
confidence count as support for further contexts.  Contexts of high confidence then yield candidates that
no pattern knows, as spans of kind ``context``.  Identifiers of letters alone are no candidates.
DataFrame expressions only; running sums go block by block, so that the work follows the length of a text.

Cases: a null or empty text has no spans; repeated rows each get a row; an empty table gives an
empty result; other columns are ignored; rows with a null id are matched by their text.
Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from betascape.llm.common import BLOCK, cut, let, ready, running

MARK, OTHER = "\u0001", "\u0002"
KINDS = ("email", "ip", "card", "phone", "context")

#: Java patterns of the kinds.  They begin at the start of a run or where the last match ended, and
#: never give back what they took, which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these characters has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: An identifier-like candidate: runs without white space that hold a digit or an @, single blanks between them.
RUN = r"[^\s0-9@]*+[0-9@]\S*+"
TOKEN = rf"(?<!\S){RUN}(?:\x20{RUN})*+"
#: What is not its core: marks before and after.
LEAD, TAIL = r"^[^A-Za-z0-9@+]++", r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$"
#: Longer candidates are known by a digest.
LONG = 64
#: Code points of a text that are cut at once.
CHUNK = 1024


def luhn(digits: Column) -> Column:
    places = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: let(F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def cut_at(text: Column, pattern: str) -> Column:
    """Parts of a text: what lies between matches at even places, matches at odd ones."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def with_places(parts: Column) -> Column:
    """Structs (start, end, i) of the odd parts, of which there is one at least."""
    at = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
    ends = running(F.transform(parts, lambda p: F.length(p)), lambda a, b: a + b)
    return let(ends, lambda e: F.transform(at, lambda i: F.struct(F.get(e, i - 1).alias("start"), F.get(e, i).alias("end"), i.alias("i"))))


def spans_of(text: Column, kind: str) -> Column:
    """Array of (start, end) of the valid matches of one kind."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    k = F.lit(KINDS.index(kind))

    def found(parts: Column) -> Column:
        kept = F.filter(with_places(parts), lambda m: valid(kind, F.get(parts, m["i"])))
        return F.transform(kept, lambda m: F.struct(k.alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    here = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    here = here & (text.rlike("[0-9]") if kind != "email" else F.lit(True))
    return F.when(here, let(cut_at(text, PATTERNS[kind]), lambda p: F.when(F.size(p) > 1, found(p)).otherwise(none))).otherwise(none)


def candidates(text: Column, base: Column, min_digits: int) -> Column:
    """Identifier-like candidates: core, place, whether a base span meets it, and its contexts."""
    none = F.array().cast("array<struct<token:string,start:int,end:int,known:boolean,contexts:array<string>>>")

    def near(parts: Column, i: Column, words: int, right: bool) -> Column:
        gap = F.lower(F.get(parts, i + (1 if right else -1)))
        p = r"^\s++(\S++)" if right else r"(?<!\S)(\S++)\s++$" if words == 1 else r"(?<!\S)(\S++\s++\S++)\s++$"
        return F.regexp_extract(gap, p, 1)

    def token(parts: Column, m: Column, blocks: Column) -> Column:
        whole = F.get(parts, m["i"])
        rest = F.regexp_replace(whole, LEAD, "")
        core = F.regexp_replace(rest, TAIL, "")
        lo = m["start"] + F.length(whole) - F.length(rest)
        hi = lo + F.length(core)
        one, two, after = near(parts, m["i"], 1, False), near(parts, m["i"], 2, False), near(parts, m["i"], 1, True)
        contexts = F.array(
            F.when(one != "", F.concat(F.lit("1 "), one)),
            F.when(two != "", F.concat(F.lit("2 "), F.regexp_replace(two, r"\s+", " "))),
            F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("b"), one, after)),
        )
        meets = lambda s: (s["start"] < hi) & (s["end"] > lo)
        known = F.exists(blocks, lambda b: meets(b) & F.exists(b["spans"], meets))
        name = F.when(F.length(core) > LONG, F.sha2(core, 256)).otherwise(core)
        digits = F.length(F.regexp_replace(core, "[^0-9]++", ""))
        return F.struct(
            name.alias("token"), lo.alias("start"), hi.alias("end"), known.alias("known"), F.array_compact(contexts).alias("contexts"),
            ((digits >= min_digits) | F.contains(core, F.lit("@"))).alias("like"),
        )

    def found(parts: Column) -> Column:
        # Base spans in blocks with the least start and the greatest end, so that few are looked at for each candidate.
        ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        at = F.sequence(F.lit(0), F.floor((F.size(base) - 1) / BLOCK).cast("int"))
        blocks = let(ordered, lambda o: F.transform(at, lambda b: let(F.slice(o, b * BLOCK + 1, BLOCK), lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("start"), F.array_max(F.transform(p, lambda s: s["end"])).alias("end"), p.alias("spans")))))
        none = F.array().cast("array<struct<start:int,end:int,spans:array<struct<start:int,end:int>>>>")
        all_ = let(F.when(F.size(base) > 0, blocks).otherwise(none), lambda b: F.transform(with_places(parts), lambda m: token(parts, m, b)))
        kept = F.filter(all_, lambda t: t["known"] | t["like"])
        return F.transform(kept, lambda t: F.struct(*[t[c].alias(c) for c in ("token", "start", "end", "known", "contexts")]))

    return F.when(text.rlike("[0-9@]"), let(cut_at(text, TOKEN), lambda p: F.when(F.size(p) > 1, found(p)).otherwise(none))).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans in the order of kinds, then of starts."""
    return F.concat(*[spans_of(text, k) for k in KINDS[:-1]])


def safe(text: Column) -> Column:
    """The text, with the character that marks matches replaced by another that no pattern knows."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, OTHER)


def learn(tokens: DataFrame, rounds: int = 3, min_support: int = 5, min_confidence: float = 0.8) -> DataFrame:
    """(context, confidence): contexts of at least min_support trusted candidates, after some rounds.

    ``tokens`` has token, known and contexts for every place.  Trusted are those that base spans meet, and those whose
    contexts, as independent witnesses, leave a doubt of 1 - min_confidence at most.
    """
    edges = cut(tokens.select("token", "known", F.explode("contexts").alias("context")).groupBy("token", "context").agg(F.max("known").alias("known")))
    seeds = cut(edges.groupBy("token").agg(F.max(F.col("known").cast("double")).alias("seed")))
    score, contexts = seeds.select("token", F.col("seed").alias("s")), None
    for k in range(rounds):
        # Scores and contexts come from checkpoints, so that the joins can split a frequent candidate's or context's edges.
        contexts = cut(edges.join(score, "token").groupBy("context").agg(
            (F.sum("s") / (F.count("*") + 1)).alias("confidence"), F.sum((F.col("s") >= min_confidence).cast("long")).alias("support"),
        ).where(F.col("support") >= min_support))
        if k + 1 < rounds:
            doubt = edges.join(contexts, "context").groupBy("token").agg(F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))).alias("doubt"))
            score = cut(seeds.join(doubt, "token", "left").select("token", F.greatest("seed", 1 - F.coalesce("doubt", F.lit(1.0))).alias("s")))
    return contexts.select("context", "confidence")


def discover(docs: DataFrame, min_confidence: float = 0.8, min_digits: int = 4, rounds: int = 3, min_support: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, base, added): spans of each distinct (id, text); digest names the text."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), safe(F.col(text_col)).alias("t"))
    rows = rows.select("doc_id", "digest", let(F.struct(F.col("t").alias("t"), base_spans(F.col("t")).alias("b")), lambda x: F.struct(x["b"].alias("base"), candidates(x["t"], x["b"], min_digits).alias("tokens"))).alias("x"))
    rows = cut(rows.select("doc_id", "digest", "x.base", "x.tokens"))
    places = rows.select("doc_id", "digest", F.inline("tokens"))
    contexts = learn(places, rounds, min_support, min_confidence).where(F.col("confidence") >= min_confidence)
    new = places.where(~F.col("known")).select("doc_id", "digest", "start", "end", F.explode("contexts").alias("context"))
    new = new.join(contexts, "context", "left_semi").groupBy("doc_id", "digest").agg(
        F.array_sort(F.collect_set(F.struct(F.lit(KINDS.index("context")).alias("kind"), "start", "end"))).alias("added")
    )
    a, b = rows.alias("a"), new.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return a.join(b, same, "left").select("a.doc_id", "a.digest", "a.base", F.coalesce("b.added", none).alias("added"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """Per document: counts of base spans by kind, their digest, and all spans as text."""
    rows = discover(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id", *[count(k) for k in KINDS[:-1]], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_context"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of spans that overlap, the first is named."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def part(chunks: Column, lo: Column, hi: Column) -> Column:
        a, b = F.floor(lo / CHUNK).cast("int"), F.floor(hi / CHUNK).cast("int")
        head = lambda n: F.substring(F.coalesce(F.get(chunks, a), F.lit("")), lo - a * CHUNK + 1, n)
        tail = F.substring(F.coalesce(F.get(chunks, b), F.lit("")), F.lit(1), hi - b * CHUNK)
        return F.when(hi <= lo, F.lit("")).when(a == b, head(hi - lo)).otherwise(F.concat(head(F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, b - a - 1), ""), tail))

    def built(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(F.lit(0))
        piece = lambda s, i: F.when(s["start"] >= before(i), F.array(part(x["chunks"], before(i), s["start"]), F.get(names, s["kind"]))).otherwise(F.array().cast("array<string>"))
        rest = part(x["chunks"], F.element_at(x["ends"], -1), F.length(text))
        return F.concat(F.array_join(F.flatten(F.transform(x["spans"], piece)), ""), rest)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    all_ = let(ordered, lambda o: F.struct(o.alias("spans"), running(F.transform(o, lambda s: s["end"]), F.greatest).alias("ends"), chunks.alias("chunks")))
    return F.when(F.size(spans) > 0, let(all_, built)).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns and rows, with personal data in the text replaced by kind names."""
    found = discover(docs, id_col=id_col, text_col=text_col, **options).where(F.size("base") + F.size("added") > 0).dropDuplicates(["doc_id", "digest"])
    found = found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.concat("base", "added").alias("__spans"))
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col("__spans")))
    return joined.withColumn(text_col, text).select(*docs.columns)


