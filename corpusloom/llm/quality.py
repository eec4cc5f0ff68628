"""Statistics of a text that tell natural prose from lists, tables and junk, with fixed published thresholds.

All statistics are built-in column expressions. The rules are those published with large web corpora: words and mean word length, symbols
per word, lines that begin with bullets or end in an ellipsis, words with a letter, common words (Rae et al. 2021), lines that end in
punctuation (Raffel et al. 2020) and repeated lines. Each rule that fails is recorded as a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common words of English, French, German and Spanish.
COMMON_WORDS = (
    "the be to of and that have with this for not on at by from or an as it is are was were been had has he she they his her its their in a but so which who when after before between could would there than then one no if into also about out up all no some most more other only very".split()
    + "le la les un une des du de et en que qui dans pour pas sur au aux avec ce cette ces il elle ils elles est était sont était avait ont a été plus par ou où mais comme ne se sa son ses leur y on dit aussi cela selon avant quand".split()
    + "der die das den dem des ein eine einen einem einer und in zu mit von für auf ist war waren nicht auch an als so sich dass im es er sie wie bei nach aus noch zum zur man aber oder wurde wurden hat haben seit nur sondern kaum damit weil um".split()
    + "el la los las un una unos unas de del y en que con por para su sus no es era eran se lo al como más pero o si había han ha habían antes entre tan ni cuando según desde".split()
)
_WORD = r"[\p{L}\p{N}]+"
#: A tag, a command or an environment of markup, and a wiki link's brackets, which count as nothing.
_MARKUP = r"<[/!]?[A-Za-z][^<>]*>|\\(?:begin|end)\{[a-z*]+\}(?:\{[^{}]*\})?|\\(?:item|textbf|textit|emph|section|subsection|cite|ref|label)\b|&[a-z]+;"


def statistics(texts: DataFrame, key: str = "index", text: str = "text") -> DataFrame:
    """One row of statistics for each row with a key.

    key, chars, words, letters, mean_word, symbols_per_word, alpha_words, common_share, common_distinct, lines, line_words, punctuated_lines,
    bullet_lines, ellipsis_lines, repeated_lines, sentence_ends, cells, separators, digits_share, odd_share, long_words, plain_words, broken_words, vowelless. A null text has
    the statistics of an empty one; shares of nothing are 0. Repeated rows come out as often. Other columns are ignored.
    """
    t = F.coalesce(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), _MARKUP, " "), F.lit(""))
    base = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), t.alias("t"))
    count = lambda pattern, column="t": F.regexp_count(column, F.lit(pattern))
    kept = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).alias(a)
    many = lambda pattern: F.size(F.filter("ls", lambda x: x.rlike(pattern)))
    known = sorted(set(COMMON_WORDS))
    low = F.lower("t")
    s = base.select("key", "t", low.alias("low"), F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("ls"), F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)).alias("ws"))
    taken = F.struct(
        F.length("t").alias("chars"),
        count(_WORD).alias("words"),
        kept(r"\p{L}+").alias("letters"),
        kept(r"\p{N}+").alias("digits"),
        (F.length("t") - count(r"\s")).alias("visible"),
        count(r"[^\p{L}\p{N}\s.,;:!?'’\"()\-]").alias("symbols_per_word"),
        count(r"[\p{N}]*\p{L}[\p{L}\p{N}]*").alias("alpha_words"),
        F.size(F.filter("ws", lambda w: w.isin(known))).alias("common_share"),
        F.size(F.array_intersect("ws", F.array(*map(F.lit, known)))).alias("common_distinct"),
        F.size("ls").alias("lines"),
        many(r"[.!?…:][\"'”’)\]]*\s*$").alias("punctuated_lines"),
        many(r"^\s*([-*•+#]|\(?[\p{L}\p{N}]{1,3}[.)])\s").alias("bullet_lines"),
        many(r"(…|\.\.\.)\s*$").alias("ellipsis_lines"),
        (F.size("ls") - F.size(F.array_distinct(F.transform("ls", lambda x: F.regexp_replace(x, r"[\W\d]+", " "))))).alias("repeated_lines"),
        count(r"\p{Ll}[\"'”’)]*[.!?](\s|$)").alias("sentence_ends"),
        many(r"\S(\t|\s*\|\s*|;| {3,}|,)\S.*\S?(\t|\s*\|\s*|;| {3,}|,)\S").alias("cells"),
        count(r"[,;]\s").alias("separators"),
        count(r"[.,;:!?'’\"()\-]").alias("plain_signs"),
        count(r"\S{40,}").alias("long_words"),
        count(r"(?<!\S)\p{Lu}?\p{Ll}{2,}(?=[\s.,;:!?]|$)").alias("plain_words"),
        F.regexp_count(F.regexp_replace("t", r"\[\[[^\[\]]*\]\]|\{\{[^{}]*\}\}", " "), F.lit(r"\p{L}[^\p{L}\p{N}\s.,'’\-_&/\\<>()\[\]{}=*\"^$]\p{L}|\p{L}\p{N}\p{L}")).alias("broken_words"),
        F.size(F.filter("ws", lambda w: w.rlike("^[bcdfghjklmnpqrstvwxz]{4}"))).alias("vowelless"),
    )
    # generated, every count is taken once: put in place of its name in shares, rules and filters, it would be taken wherever it is used
    counts = s.select(F.col("key").alias(key), F.inline(F.array(taken)))
    counts = counts.withColumns({"mean_word": F.col("letters") + F.col("digits"), "odd_share": F.col("visible") - F.col("letters") - F.col("digits") - F.col("plain_signs"), "digits_share": F.col("digits"), "line_words": F.col("words")})
    by_words, by_lines, by_signs = ([share(c, b) for c in names.split()] for names, b in (("mean_word symbols_per_word alpha_words common_share plain_words broken_words vowelless", "words"), ("line_words punctuated_lines bullet_lines ellipsis_lines repeated_lines cells", "lines"), ("digits_share odd_share", "visible")))
    return counts.select(key, "chars", "words", "letters", "common_distinct", "lines", "sentence_ends", "separators", "long_words", *by_words, *by_lines, *by_signs)


#: Conditions on the statistics under which a text fails, by reason.
RULES = {
    "few words": "words < 50",
    "many words": "words > 100000",
    "word length": "mean_word not between 3 and 10",
    "symbols": "symbols_per_word > 0.1",
    "bullets": "bullet_lines > 0.9",
    "ellipses": "ellipsis_lines > 0.3",
    "words without letters": "alpha_words < 0.8",
    "few common words": "common_distinct < 2",
    "unpunctuated lines": "punctuated_lines < 0.12",
    "repeated lines": "repeated_lines > 0.3",
}


def judged(stats: DataFrame) -> DataFrame:
    """The statistics with ``reasons``: the names of the rules that fail."""
    return stats.withColumn("reasons", F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]), lambda x: x.isNotNull()))


#: What a text mostly is that fails a rule. Prose has common words in every sentence and whole words, and fails for being short or full of signs; of the
#: rest, tables have rows of cells, junk has odd signs within words, words without vowels or overlong ones, or the same line again and again, and lists
#: have short lines or many separators. The thresholds here are this project's own.
KIND = """case
  when words = 0 or broken_words > 0.15 and cells * lines < 2 then 'junk'
  when common_share >= 0.15 and repeated_lines <= 0.5 then 'prose'
  when lines >= 2 and cells >= 0.5 then 'table'
  when lines >= 3 and repeated_lines >= 0.4 or vowelless > 0.2 or odd_share > 0.15 or mean_word > 12 then 'junk'
  when lines >= 3 and line_words <= 8 or separators * 6 >= words then 'list'
  else 'junk' end"""


def kinds(stats: DataFrame) -> DataFrame:
    """The statistics with ``reasons`` and ``kind``: prose, list, table or junk.

    The published rules decide which texts may be anything but prose: one that fails none is prose, one that fails some is named by ``KIND``. An
    empty or null text fails them and is junk.
    """
    return judged(stats).withColumn("kind", F.when(F.size("reasons") == 0, "prose").otherwise(F.expr(KIND)))
