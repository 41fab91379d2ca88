"""Licence scans by canonical digest: entire texts, normalised, hash-joined to known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnwise.llm.license_texts import EQUIVALENT, KNOWN, NOTICE

KNOWN_BROADCAST_ROWS = 10_000  # rows of a known-licence table that are broadcast at most


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text: lower case, copyright notices removed (``NOTICE``), equivalent
    spellings made one, everything but letters and digits one space, no empty lines.  A line of terms
    that begins with "copyright" or with the list mark "(c)" stays."""
    out = F.array_join(F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(NOTICE)), "\n")
    for pattern, word in EQUIVALENT:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(word))
    out = F.regexp_replace(out, F.lit("[^a-z0-9\n]+"), F.lit(" "))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def canonical_text(text: Column) -> Column:
    return F.array_join(canonical_lines(text), " ")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, size, digest) of the known licence texts and notices (or of ``texts``)."""
    given = spark.createDataFrame(texts if texts is not None else KNOWN, "license_id string, text string")
    canonical = canonical_text(F.col("text"))
    return given.select("license_id", canonical.alias("c")).where(F.col("c") != "").select(
        "license_id", F.length("c").alias("size"), digest(F.col("c")).alias("digest")).distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, scope, license_id, matches) of every entire text that is a known licence.

    An entire text is a whole document (scope ``document``) or one line that stands alone
    as a notice (scope ``line``); it matches when its canonical form has the digest of a
    known one.  Digests are only computed for texts as long as some known one, which
    loses none.  Documents without a match have no row; null and empty texts never match;
    rows that repeat an id are counted together, null ids too.  A very long text is read whole, an
    empty table gives no row, and of ``docs`` only the two named columns are read, so others cannot
    clash.  Known tables of up to ``KNOWN_BROADCAST_ROWS`` rows are broadcast, larger ones joined by digest.
    """
    sizes = known.agg(F.collect_set("size")).scalar()  # the lengths that occur
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"),
                        sizes.alias("sizes"))
    units = F.concat(F.array(F.struct(F.lit("document").alias("scope"), F.array_join("lines", " ").alias("c"))),
                     F.transform("lines", lambda x: F.struct(F.lit("line").alias("scope"), x.alias("c"))))
    fitting = F.filter(units, lambda u: F.array_contains("sizes", F.length(u["c"])))
    found = (lines.select("doc_id", F.explode(fitting).alias("u"))
             .select("doc_id", "u.scope", digest(F.col("u.c")).alias("digest")))
    table = known.select("license_id", "digest")
    if known.count() <= KNOWN_BROADCAST_ROWS:
        table = F.broadcast(table)
    return found.join(table, "digest").groupBy("doc_id", "scope", "license_id").agg(
        F.count(F.lit(1)).alias("matches"))


def scan_sql(texts: list[tuple[str, str]] | None = None) -> str:
    """The scan of ``documents`` as DuckDB SQL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def canonical(column: str) -> str:
        out = (f"array_to_string(list_filter(string_split(lower({column}), chr(10)), "
               f"lambda x: NOT regexp_matches(x, {quoted(NOTICE)})), chr(10))")
        for pattern, word in EQUIVALENT:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(word)}, 'g')"
        out = f"regexp_replace({out}, '[^a-z0-9\n]+', ' ', 'g')"
        return (f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x, ' ')), "
                f"lambda x: x <> '')")

    given = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in (texts if texts is not None else KNOWN))
    return f"""
WITH given(license_id, text) AS (VALUES {given}),
known AS (SELECT DISTINCT license_id, sha256(array_to_string({canonical('text')}, ' ')) AS digest FROM given),
l AS (SELECT doc_id, {canonical('text')} AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'document' AS scope, array_to_string(lines, ' ') AS c FROM l
      UNION ALL SELECT doc_id, 'line', unnest(lines) FROM l)
SELECT doc_id, scope, license_id, count(*) AS matches FROM u JOIN known ON sha256(c) = digest
GROUP BY doc_id, scope, license_id"""
