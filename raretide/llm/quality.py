"""Quality rules: base counts, and the divergence of a text's histograms from those of its language.

Everything is a DataFrame expression on one row. Two histograms of each text, one of character classes and one of
its language's common words, are compared with the histograms of all texts of that language by Jensen-Shannon
distance. Short texts are guarded: below a minimum length a histogram says too little to reject a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from raretide.llm.common import SPACE, stage

MIN_WORDS = 50
REPEAT_SHARE = 50  # per cent of the words
# Minimum-length guards and largest distances of the two comparisons.
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.32
MIN_COMMON_WORDS_TEXT, MAX_WORD_DISTANCE = 100, 0.30

# Character classes of the histogram, besides white space. What is in none of them, lower-case ASCII
# letters above all, is the class "other".
CHARACTER_CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "stop": "[.,;:]",
    "symbol": "[#*$%&|<>]",
    "mark": "[!?\"'()-]",
    "foreign": "[^\\x00-\\x7F]",
}

# Common words per language, the rest of a text's words counts as "other".
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im nicht ein eine als auch".split(),
    "en": "the of and to a in is that it on for was with as be by this are at from".split(),
    "es": "de la que el en y los se del las un por con no una para su es al lo".split(),
    "fr": "de la le et les des en un du une est que pour dans qui au sur par pas avec".split(),
}
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` with the number of words that stand in a three-word window found twice or more.

    Windows are sorted as numbers: a hash above, the position in the low bits. Equal windows become neighbours, and
    neighbours that agree in the hash bits are compared as words. Where a chance agreement of two hashes is found, the
    text's candidate windows are sorted and compared as words instead, so the count is exact. Each step is a
    projection of its own; none leaves the row.
    """
    w, n = F.col(words), F.size(words)
    h, z, low = F.col("__hash"), F.col("__windows"), F.col("__low")
    none = F.array().cast("array<bigint>")

    def agrees(x, y):
        return F.coalesce(x.bitwiseXOR(y).between(F.lit(0), low), F.lit(False))

    def word(x, k):
        return F.get(w, x.bitwiseAND(low).cast("int") + k)

    df = df.withColumn("__low", F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + 1.0)).cast("int")) - 1)
    df = df.withColumn("__hash", F.transform(w, lambda x: F.xxhash64(x)))
    pairs = F.zip_with(F.slice(h, 1, n - 2), F.slice(h, 2, n - 2), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("__windows", F.when(n > 3, F.zip_with(pairs, F.slice(h, 3, n - 2), lambda x, y: F.xxhash64(x, y))).otherwise(none))
    packed = F.sort_array(F.transform(z, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
    df = df.withColumn("__ordered", F.when(F.size(F.array_distinct(z)) < F.size(z), packed).otherwise(none))
    o, c = F.col("__ordered"), F.col("__near")
    df = df.withColumn("__near", F.filter(o, lambda x, i: agrees(x, F.get(o, i + 1)) | agrees(x, F.get(o, i - 1))))
    step = F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    df = df.withColumn("__clash", F.exists(step, lambda s: agrees(s["x"], s["y"]) & ~(
        (word(s["x"], 0) == word(s["y"], 0)) & (word(s["x"], 1) == word(s["y"], 1)) & (word(s["x"], 2) == word(s["y"], 2)))))
    same = F.sort_array(F.transform(c, lambda x: F.struct(F.concat_ws(" ", word(x, 0), word(x, 1), word(x, 2)).alias("t"), x.alias("x"))))
    df = df.withColumn("__same", F.when(F.col("__clash"), same))
    e = F.col("__same")
    twice = F.transform(F.filter(e, lambda x, i: F.coalesce(x["t"] == F.get(e, i - 1)["t"], F.lit(False)) | F.coalesce(
        x["t"] == F.get(e, i + 1)["t"], F.lit(False))), lambda x: x["x"])
    first = F.transform(F.when(F.col("__clash"), twice).otherwise(c), lambda x: x.bitwiseAND(low))
    df = df.withColumn("__first", first)
    f = F.col("__first")
    covered = F.array_distinct(F.concat(f, F.transform(f, lambda x: x + 1), F.transform(f, lambda x: x + 2)))
    return df.withColumn(out, F.size(covered).cast("long")).drop("__low", "__hash", "__windows", "__ordered", "__near", "__clash", "__same", "__first")


def _hits(words: Column, common: list[str]) -> Column:
    """The common words of a text as they are written, each between two blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(F.filter(words, lambda x: x.isin(common)), "  "), F.lit(" "))


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per document: the base counts, ``ref`` (the language it is compared with), character-class counts
    ``c0``.. and common-word counts ``w0``.. (the last of each is "other"). A null text has no words and no lines.

    ``ref`` is the row's language if it has a word list, else the language whose common words occur most.
    """
    df = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("t"), F.col(lang_column).alias("lang"))
    df = df.withColumn("w", words_of(F.col("t")))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = with_repeated_words(df, "w", "n_repeat_words")
    known = F.col("lang").isin(list(COMMON_WORDS))
    sizes = [F.struct(F.size(F.filter("w", lambda x: x.isin(common))).alias("n"), F.lit(name).alias("name")) for name, common in sorted(COMMON_WORDS.items(), reverse=True)]
    df = df.withColumn("ref", F.when(known, F.col("lang")).otherwise(F.greatest(*sizes)["name"]))
    hits = F.coalesce(*[F.when(F.col("ref") == name, _hits(F.col("w"), common)) for name, common in COMMON_WORDS.items()])
    df = df.withColumn("hits", hits)

    def count_of(k):
        one = F.coalesce(*[F.when(F.col("ref") == name, F.lit(f" {common[k]} ")) for name, common in COMMON_WORDS.items()])
        return (F.length("hits") - F.length(F.replace("hits", one, F.lit("")))) / F.length(one)

    # Most characters are lower-case letters and blanks; the classes are counted in what is left without them.
    df = df.withColumn("rare", F.regexp_replace("t", f"[a-z{SPACE}]+", ""))
    classes = [F.regexp_count("rare", F.lit(pattern)).cast("long").alias(f"c{i}") for i, pattern in enumerate(CHARACTER_CLASSES.values())]
    n_classes = len(classes)
    n_common = len(next(iter(COMMON_WORDS.values())))
    counts = [count_of(k).cast("long").alias(f"w{k}") for k in range(n_common)]
    df = df.select(
        "id", "ref", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.length("t").cast("long").alias("chars"), *classes, *counts,
    )
    others = [(F.col("chars") - F.col("word_chars")).alias(f"c{n_classes}"),  # white space
              (F.col("word_chars") - sum((F.col(f"c{i}") for i in range(1, n_classes)), F.col("c0"))).alias(f"c{n_classes + 1}"),
              (F.col("n_words") - sum((F.col(f"w{k}") for k in range(1, n_common)), F.col("w0"))).alias(f"w{n_common}")]
    return df.select("*", *others, F.col(f"c{list(CHARACTER_CLASSES).index('symbol')}").alias("n_symbols"))


def divergence(counts: list[Column], total: Column, reference: list[Column], reference_total: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence to base 2, from 0 to 1) of two histograms; null if one is empty.

    Each bin adds p log p + q log q - (p + q) log((p + q) / 2).
    """
    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x)).otherwise(F.when(x.isNotNull(), 0.0))

    parts = []
    for a, b in zip(counts, reference, strict=True):
        p, q = a / F.nullif(total, F.lit(0)), b / F.nullif(reference_total, F.lit(0))
        parts.append(term(p) + term(q) - 2 * term((p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), sum(parts[1:], parts[0]) / 2))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def language_references(statistics: DataFrame) -> DataFrame:
    """Histograms of all texts that pass the base rules, one row for each language with a word list: a handful of rows."""
    sums = [c for c in statistics.columns if c[0] in "cw" and c[1:].isdigit()] + ["chars", "n_words"]
    return statistics.where(~base_failed()).groupBy("ref").agg(*[F.sum(c).alias(f"r{c}") for c in sums])


def quality_verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance.

    ``base_failed``: fewer than 50 words, or more than half of the words in three-word windows that repeat. Other
    texts are kept unless a histogram of a long enough text is too far from that of its language. Null and empty
    texts have all counts 0, no distances, and fail. Rows are neither dropped nor merged; other columns are not read.

    The statistics are written once, with a few numbers per document; the references are sums over all documents.
    """
    stats = stage(text_statistics(docs, id_column, text_column, lang_column), "text-statistics")
    references = F.broadcast(language_references(stats))  # at most one row per word list
    bins = {x: [c for c in stats.columns if c[0] == x and c[1:].isdigit()] for x in "cw"}
    df = stats.join(references, "ref", "left")
    for x, total, name in (("c", "chars", "char_distance"), ("w", "n_words", "word_distance")):
        df = df.withColumn(name, divergence([F.col(c) for c in bins[x]], F.col(total), [F.col(f"r{c}") for c in bins[x]], F.col(f"r{total}")))
    failed = base_failed()
    far = ((F.col("chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= MIN_COMMON_WORDS_TEXT) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return df.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance")
