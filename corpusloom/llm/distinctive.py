"""How distinctive a term is of a record: residual inverse document frequency times record frequency.

The residual is the observed -log2(df / N) minus the one a Poisson law expects from the collection frequency,
-log2(1 - exp(-cf / N)); it is high for terms that stand many times in few records.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import record_text
from ..functions.words import LETTERS
from ..session import map_arrow, written

MIN_LETTERS = 4
#: Terms of one in so many records count as common.
COMMON = 1000
_SCHEMA = pa.schema([("index", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])


def record_terms(records: DataFrame, index: str = "index", data: str = "bytes", form: str = "form", least: int = MIN_LETTERS) -> DataFrame:
    """index, term, tf: maximal runs of at least ``least`` letters, lower-cased, of each record's text, and how often each stands.

    Records that are null or ill-formed give no rows; every other one gives a further row with a null term and tf 0, by which
    records are counted. An index given more than once must be parted beforehand. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            names: list[str | None] = []
            times: list[int] = []
            for i, b, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = record_text(b, f)
                if text is None:
                    continue
                found = Counter(LETTERS.findall(text.lower()))
                kept = {None: 0} | {t: n for t, n in found.items() if len(t) >= least}
                ids.extend([i] * len(kept))
                names.extend(kept)
                times.extend(kept.values())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(times, pa.int64())], schema=_SCHEMA)

    chosen = records.select(F.col(index).cast("bigint").alias("index"), F.col(data).cast("binary").alias("bytes"), F.col(form).alias("form"))
    return map_arrow(chosen.where("index is not null and bytes is not null"), count, "index bigint, term string, tf bigint")


def text_terms(texts: DataFrame, key: str, text: str, least: int = MIN_LETTERS) -> DataFrame:
    """The same of a column of texts (several rows of a key add up), with built-in functions only; null keys or texts give no rows."""
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    own = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    rows = own.select(F.col(key).alias("index"), F.explode(F.concat(F.array(F.lit(None).cast("string")), runs)).alias("term"))
    return rows.groupBy("index", "term").agg(F.count("term").alias("tf"))


def statistics(counts: DataFrame) -> DataFrame:
    """term, df (records), cf (occurrences), records (all), residual: over all rows of (index, term, tf)."""
    # a term stands once per record, so counting is a plain sum with map-side combination; the null term counts the records
    every = counts.where("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms = every.withColumn("records", counts.where("term is null").agg(F.count("*")).scalar())
    return terms.withColumn("residual", _residual(F.col("df"), F.col("cf"), F.col("records")))


def _residual(df: Column, cf: Column, records: Column) -> Column:
    return F.log2(-F.expm1(-cf / records)) - F.log2(df / records)


def scores(counts: DataFrame) -> DataFrame:
    """index, term, tf, df, cf, records, residual, score = tf x residual, for each row of (index, term, tf) with a term.

    Terms of at least one in ``COMMON`` records are looked up in a table that is sent to every task; as all terms of all records add up, there are at
    most ``COMMON`` times as many as a record has on average. So no term that many rows share is joined by shuffling. Equal scores are ties and stay so.
    Empty input gives no rows.
    """
    counts = written(counts)  # tokenised once; read by column for the statistics and for the scores
    stats = written(statistics(counts))
    common = F.broadcast(stats.where(F.col("df") * COMMON >= F.col("records")))
    rows = counts.where("term is not null")
    rest = rows.join(common.select("term"), "term", "left_anti").join(stats.where(F.col("df") * COMMON < F.col("records")), "term")
    out = rows.join(common, "term").unionByName(rest)
    return out.select("index", "term", "tf", "df", "cf", "records", "residual", (F.col("tf") * F.col("residual")).alias("score"))


def concentrated(scored: DataFrame, tf: int, df: int) -> DataFrame:
    """Terms that stand at least ``tf`` times in a record and in at most ``df`` records, by their scores.

    A score is compared with ``tf`` times the least residual that such a term can have; what passes is then checked exactly.
    """
    # with d records there are at least tf + d - 1 occurrences, and the residual grows with these
    least = F.least(*[_residual(F.lit(d), F.lit(tf + d - 1), F.col("records")) for d in range(1, df + 1)]) if df > 1 else _residual(F.lit(1), F.lit(tf), F.col("records"))
    return scored.where((F.col("score") >= F.col("tf") * (least - 1e-9)) & (F.col("tf") >= tf)).where(F.col("df") <= df)
