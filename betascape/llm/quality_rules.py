"""Quality rules kept as a bitmask ledger.

Each rule is evaluated once per document.  The ledger keeps the measurements and one long whose
bit b says that rule b failed.  A policy is a named, versioned mask of rules: a document is
rejected if it fails any rule of the mask.  Policies and ablations read the ledger only, so a new
policy needs no second pass over texts.  DataFrame expressions throughout.

Cases: a null or empty text has no words (all counts 0) and fails ``few_words``; repeated rows
each get a row; an empty table gives an empty ledger; other columns are ignored, unless named in
``keep``; a null id stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from betascape.llm.common import SPACE, let

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules in the order of their bits: the document fails where the expression is true.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_words > 0 and 10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines > 3 and 100 * n_dup_lines > 60 * n_lines",
    "short_words": "n_words > 0 and word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}

#: name -> version -> the rules that it applies; the last version holds unless one is named.
POLICIES: dict[str, dict[int, tuple[str, ...]]] = {
    "base": {1: ("few_words", "repeated_windows")},
    "corpus": {1: ("few_words", "repeated_windows", "symbols", "repeated_lines"), 2: tuple(RULES)},
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def policy_mask(name: str, version: int | None = None) -> int:
    versions = POLICIES[name]
    return mask(versions[max(versions) if version is None else version])


def repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are hashed, sorted with their places, and compared with their neighbours; the places
    of repeated ones, sorted again, cover 3 words each, less where the next begins sooner.
    """
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            near = lambda d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
            return near(1) | near(-1)

        return F.array_sort(F.transform(F.filter(s, repeated), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        ends = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1), x + 3) - x))
        return F.aggregate(ends, F.lit(0), lambda a, x: a + x)

    return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(windows), lambda s: let(places(s), covered)))


def measure(text: Column) -> Column:
    """A struct of all measurements of one text."""
    full = F.coalesce(text.cast("string"), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(full, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.translate(full, " \t\n\u000b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(full) - F.length(F.translate(full, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("lines"),
            repeat_words(words, n).cast("long").alias("n_repeat_words"),
        )

    return let(F.filter(F.split(full, SPACE + "+", -1), lambda w: w != ""), counts)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, measurements, failure bits (and the columns named in ``keep``)."""
    m = docs.select(F.col(id_col), *[F.col(c) for c in keep], measure(F.col(text_col)).alias("__m"))
    flat = m.select(
        id_col, *keep, "__m.n_words", "__m.word_chars", "__m.n_symbols",
        F.col("__m.lines.dup").alias("n_dup_lines"), F.col("__m.lines.all").alias("n_lines"), "__m.n_repeat_words",
    )
    bits = [F.when(F.expr(e), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, e in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return flat.withColumn("failed_bits", out)


def apply_policy(rows: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """Add ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy_mask(name, version))) == 0)


def ablation(rows: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that stay without it."""
    m = policy_mask(name, version)
    rules = [r for r in RULES if mask((r,)) & m]
    b = F.col("failed_bits").bitwiseAND(F.lit(m))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = rows.agg(*[
        F.struct(
            F.lit(r).alias("rule"), count(b.bitwiseAND(F.lit(k)) != 0).alias("n_failed"),
            count(b == k).alias("n_only"), count(b.bitwiseAND(F.lit(m & ~k)) == 0).alias("n_kept_without"),
        ).alias(r)
        for r in rules for k in (mask((r,)),)
    ])
    return sums.select(F.inline(F.array(*[F.col(r) for r in rules])))
