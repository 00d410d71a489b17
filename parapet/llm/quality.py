"""Quality rules with host verdicts (DataFrame functions only).

Documents fail rules; hosts collect failures. A host with few documents says
little about itself, so its failure rate is shrunk toward the rates of all hosts
by a beta prior fitted to them (moments). Hosts whose shrunk rate is too high are
rejected with all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, word_array

#: Rules of a document, beside the base rules.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUPLICATE_LINES = 0.5
#: A host is rejected when the shrunk rate of any rule is above this.
MAX_HOST_RATE = 0.6
#: Parts in which the rows of one host join its verdict.
SALTS = 32
RULES = ("short", "repeats", "symbols", "lines")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Sorted with their places, equal
    windows are neighbours; the places found are then walked in order, each
    adding the words that the last one has not covered.
    """
    gram = lambda ws: F.transform(
        F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2))
    )
    same = lambda xs, i, j: F.get(xs, j)["h"].eqNullSafe(F.get(xs, i)["h"])

    def walk(placed: Column) -> Column:
        found = F.transform(placed, lambda x, i: F.when(same(placed, i, i - 1) | same(placed, i, i + 1), x["i"]))
        return F.aggregate(
            F.array_sort(F.array_compact(found)),
            F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum"), i.alias("last")),
            lambda acc: acc["sum"],
        )

    def count(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Without repeats, the usual case, a set is enough.
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(placed, walk))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(gram(words), count)).cast("long")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """doc_id, host and the five counts of every document; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = (F.col("source") if host is None else host).cast("string")
    bare = lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != ""
    out = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), text.alias("text"), word_array(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), bare)
    repeated = let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    return out.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        repeated.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def host_verdicts(failures: DataFrame, rules=RULES, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Shrunk failure rates and verdict of each host: host, n_docs, rate_<rule>..., host_ok.

    Prior of a rule: a beta distribution with the mean of all documents' failures
    and the spread of the hosts' rates, each host weighing its documents, less
    the spread that chance alone gives (moments). Without any spread beyond
    chance the prior is as heavy as all documents of a mean host together.
    ``failures`` has columns host and fail_<rule> (0 or 1).
    """
    per = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(f"fail_{r}").alias(f"n_{r}") for r in rules])
    # The moments of all hosts are one row.
    m = per.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"),
        F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"n_{r}").alias(f"all_{r}") for r in rules],
        *[F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / F.col("n_docs")).alias(f"sq_{r}") for r in rules],
    ).first()
    out = per
    for r in rules:
        mean = m[f"all_{r}"] / m["docs"] if m["docs"] else 0.0
        heavy = m["docs"] / m["hosts"] if m["hosts"] else 1.0
        extra = (m[f"sq_{r}"] / m["docs"] - mean * mean - mean * (1 - mean) * m["hosts"] / m["docs"]) if m["docs"] else 0.0
        weight = min(heavy, max(1.0, mean * (1 - mean) / extra - 1)) if extra > 0 else heavy
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(float(weight))))
    ok = F.greatest(*[F.col(f"rate_{r}") for r in rules]) <= max_rate if len(rules) > 1 else F.col(f"rate_{rules[0]}") <= max_rate
    return out.select("host", "n_docs", *[f"rate_{r}" for r in rules], ok.alias("host_ok"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Features, base rules, host verdict and ``kept`` of every document.

    Base rules: fewer than 50 words, or over half of the words inside repeated
    3-word windows. A null host is a host of its own. Rows with equal ids are
    judged one by one; an empty table gives an empty result.
    """
    f = features(docs, id_col=id_col, text_col=text_col, host=host)
    short, repeats = F.col("n_words") < 50, 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    rules = {
        "short": short,
        "repeats": repeats,
        "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"),
        "lines": F.col("n_dup_lines") > MAX_DUPLICATE_LINES * F.col("n_lines"),
    }
    f = f.withColumns({f"fail_{r}": rules[r].cast("int") for r in RULES} | {"base_failed": short | repeats})
    f = table(f, "quality-features")
    verdicts = host_verdicts(f, max_rate=max_rate)
    # A hot host's rows meet its verdict in SALTS parts.
    salted = verdicts.select(F.col("host").alias("of"), "host_ok", *[f"rate_{r}" for r in RULES], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    return (
        f.withColumn("salt", part)
        .join(salted, F.col("host").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
        .select(
            "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            *[f"rate_{r}" for r in RULES], "host_ok", (~F.col("base_failed") & F.col("host_ok")).alias("kept"),
        )
    )
