"""SRC7-SRC11: CSV batch sources with declared column contracts.

Files are read by RFC 4180: cells may be quoted, a doubled quote is a quote, and
quoted cells may hold commas and line breaks.  Every cell is read as a string (no
schema inference) in PERMISSIVE mode, so bad values become row-level validation
errors (``operators.ingest``) rather than job failures; a line with too few or too
many cells keeps what it has, and stands whole in the column ``MALFORMED``.  A
``row_num`` column records file order for ``skip_duplicates``: a string key of file,
block and row that sorts as the rows stand in their files, over any number of files,
and names each row once.

A cell's line breaks make a file unsplittable, so each file is one task: large
batches come as several files.  ``multi_line=False`` splits files of which it is
known that no cell holds a line break.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caremart.schemas import (ASSESSMENT_CSV, INDIVIDUALS_CSV, INTERVENTIONS_CSV, OUTCOMES_CSV_OPTIONAL,
                              OUTCOMES_CSV_REQUIRED)


MALFORMED = "_malformed"
# RFC 4180: cells between double quotes, a quote inside doubled
QUOTING = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write headered CSV files that keep every cell as it is (quotes, commas, line breaks, spaces at its ends)."""
    df.write.mode(mode).options(**QUOTING).csv(path)


def _read(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    reader = spark.read.options(**QUOTING).option("multiLine", multi_line).option("mode", "PERMISSIVE")
    names = reader.option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, MALFORMED]])
    return (reader.schema(schema).option("columnNameOfCorruptRecord", MALFORMED).option("enforceSchema", False).csv(path))


def read_contract_csv(spark: SparkSession, path: str, required: Sequence[str],
                      optional: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """Read a headered CSV as strings: the header's columns, absent optional ones as NULL, and ``row_num``.

    No inference: every cell stays a string (PERMISSIVE mode, short lines padded
    with NULL), so conversion problems surface as ING2 rows.  Absent required
    columns are left absent for ``ingest.missing_columns`` (ING1) to report.  All
    files carry the same header (else the read fails).  ``malformed_lines`` reads the
    lines whose number of cells is not the header's.
    """
    df = _read(spark, path, multi_line).drop(MALFORMED)
    for c in optional:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(*[F.col(f"`{c}`") for c in df.columns], file_order().alias("row_num"))


def malformed_lines(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``row_num, line``: the lines of a headered CSV with too few or too many cells, as they stand."""
    df = _read(spark, path, multi_line)
    # all cells are read along: with the malformed column alone Spark would not parse the line
    cells = F.array(*[F.col(f"`{c}`") for c in df.columns if c != MALFORMED])
    return (df.select(file_order().alias("row_num"), F.col(MALFORMED).alias("line"), cells.alias("_cells"))
            .where(F.col("line").isNotNull() & (F.size("_cells") >= 0)).drop("_cells"))


def file_order():
    """A sortable key of a row's place: file path, block start and row within the split.

    Splits of one file never interleave: a split starts at its block, and rows within a
    task are numbered in reading order.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.concat_ws("#", F.col("_metadata.file_path"),
                       F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"),
                       F.lpad(row.cast("string"), 12, "0"))


def read_outcomes_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: bulk outcome CSV (required + optional columns)."""
    return read_contract_csv(spark, path, OUTCOMES_CSV_REQUIRED, OUTCOMES_CSV_OPTIONAL)


def read_individuals_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: individuals CSV contract."""
    return read_contract_csv(spark, path, INDIVIDUALS_CSV)


def read_interventions_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: interventions CSV contract."""
    return read_contract_csv(spark, path, INTERVENTIONS_CSV)


def read_batch_update_csv(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """SRC10: batch-update CSV keyed by ``record_id`` (feeds ``updates.batch_update``)."""
    return read_contract_csv(spark, path, ["record_id"], cols)


def read_mapped_csv(spark: SparkSession, path: str, mapping: Mapping[str, str]) -> DataFrame:
    """SRC11: assessment-tool CSV whose source columns are renamed by a user field mapping.

    ``mapping`` is ``{target_column: source_column}`` (e.g. ``{"individual_anonymous_id": "individual id"}``).
    """
    src = _read(spark, path, True)
    return src.select(*[F.col(f"`{s}`").cast("string").alias(t) for t, s in mapping.items()],
                      file_order().alias("row_num"))


ASSESSMENT_COLUMNS = ASSESSMENT_CSV
