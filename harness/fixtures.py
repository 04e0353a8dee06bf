"""Release tables derived from the driver's order and line-item tables.

The derivations are the ones written down in FIXTURES.md, and the oracle repeats them
in SQL. Raw frames keep duplicate keys and the columns that say which row goes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termwarden.context import CORE_MODULE, EXTENSION_MODULE, IS_A, PREFERRED, CheckContext
from termwarden.context import FULLY_SPECIFIED_NAME
from termwarden.operators.versions import LATEST, first_by, first_loaded, marked
from termwarden.plans.release import Release
from termwarden.schemas import FULL_TABLES

RELEASE = "snomed_full_SE1000052_20000531"
CONTEXT = CheckContext.for_release(
    RELEASE,
    root_concept=1000052105,
    extension_language_refset=1000052105,
    excluded_language_refsets=(11000052105, 21000052105),
)

ACCEPTABLE = 900000000000549004
SYNONYM = 900000000000013009
PLACE = 10_000_000_000

#: Columns that order the rows of a raw frame; the first row of a key stays.
LOAD_ORDER = {
    "concepts": ("o_orderkey",),
    "descriptions": ("l_partkey", "l_suppkey", "term"),
    "relationships": (),
    "languagerefsets": ("l_partkey", "l_suppkey", "l_extendedprice"),
    "simplerefsets": ("o_orderkey",),
    "refsetdescriptors": (),
    "owlrefsets": (),
}


def release(spark: SparkSession, sf_dir: str) -> Release:
    """A release over the derived tables."""
    full = {table: lambda table=table: marked_table(spark, sf_dir, table) for table in FULL_TABLES}
    made = Release(spark, RELEASE, full, CONTEXT)

    def relationships() -> DataFrame:
        # They are versions of a concept's edges, of which the latest are those of the latest.
        made.table("concepts")
        return _typed(_relationships(made.marked("concepts"), LATEST), "relationships", LATEST)

    full["relationships"] = relationships
    return made


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Size of the files that the release tables are derived from."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "part", "nation")]
    located = [spark._jvm.org.apache.hadoop.fs.Path(path) for path in paths]
    conf = spark._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in located)


def full_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A component table with its key enforced."""
    rows = raw_table(spark, sf_dir, table)
    if LOAD_ORDER[table]:
        rows = first_loaded(rows, LOAD_ORDER[table])
    return _typed(rows, table)


def marked_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """`full_table`, with latest versions marked where rows are shuffled to enforce the key."""
    if not LOAD_ORDER[table]:
        return full_table(spark, sf_dir, table)
    return _typed(marked(raw_table(spark, sf_dir, table), LOAD_ORDER[table]), table, LATEST)


def snapshot_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Latest version of every component, of equal versions the one loaded first.

    The same as the snapshot of `full_table`, with one window and so one shuffle.
    """
    rows = raw_table(spark, sf_dir, table)
    return _typed(first_by(rows, ("id",), (F.desc("effectiveTime"), *LOAD_ORDER[table])), table)


def raw_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Rows of a component table before its key is enforced, with its order columns.

    What follows from other columns of a row is left to `completed`, so that it is not shuffled.
    """
    if table == "relationships":
        return _relationships(full_table(spark, sf_dir, "concepts"))

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    if table in ("descriptions", "languagerefsets"):
        lines = read("lineitem")
        return _descriptions(lines, read("part")) if table == "descriptions" else _languagerefsets(lines)
    if table == "refsetdescriptors":
        return _refsetdescriptors(read("nation"))
    make = {"concepts": _concepts, "simplerefsets": _simplerefsets, "owlrefsets": _owlrefsets}
    return make[table](read("orders"))


def completed(rows: DataFrame, table: str) -> DataFrame:
    """Raw rows with the columns that follow from others."""
    return rows.withColumns(_LATER.get(table, dict)())


def _typed(rows: DataFrame, table: str, *more: str) -> DataFrame:
    return completed(rows, table).select(
        *(F.col(field.name).cast(field.dataType) for field in FULL_TABLES[table]), *more
    )


def _half(key: str) -> Column:
    return F.expr(f"{key} div 2")


def _concept_id(k: Column) -> Column:
    return k * PLACE + F.when(k % 4 < 3, 1000052105).otherwise(5)


def _description_id() -> Column:
    order = F.col("l_orderkey")
    suffix = F.when(order % 17 == 0, 13).otherwise(1000052113)
    return (order * 10 + F.col("l_linenumber")) * PLACE + suffix


def _release_of(date: str) -> Column:
    return F.year(date) * 10_000 + F.when(F.month(date) <= 5, 531).otherwise(1130)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _line_module() -> Column:
    return F.when(F.col("l_suppkey") % 4 == 0, CORE_MODULE).otherwise(EXTENSION_MODULE)


def _concepts(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderkey % 2 = 0 OR o_custkey % 2 = 0").select(
        _concept_id(_half("o_orderkey")).alias("id"),
        _release_of("o_orderdate").alias("effectiveTime"),
        _flag(F.col("o_orderstatus") != "F").alias("active"),
        F.when(F.col("o_custkey") % 3 == 0, CORE_MODULE)
        .otherwise(EXTENSION_MODULE)
        .alias("moduleId"),
        F.when(F.col("o_totalprice") > 250000, 900000000000073002)
        .otherwise(900000000000074008)
        .alias("definitionStatusId"),
        "o_orderkey",
    )


def _descriptions(lines: DataFrame, parts: DataFrame) -> DataFrame:
    separator = (
        F.when(F.col("l_suppkey") % 11 == 0, "  ")
        .when(F.col("l_suppkey") % 13 == 0, "! ")
        .otherwise(" ")
    )
    versions = lines.select(
        _release_of("l_shipdate").alias("effectiveTime"),
        _flag(F.col("l_returnflag") != "R").alias("active"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    return versions.join(parts, versions["l_partkey"] == parts["p_partkey"]).select(
        _description_id().alias("id"),
        "effectiveTime",
        "active",
        F.concat("p_name", separator, F.lit("("), F.lower("p_type"), F.lit(")")).alias("term"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def _of_descriptions() -> dict[str, Column]:
    return {
        "moduleId": _line_module(),
        "conceptId": _concept_id(_half("l_orderkey")),
        "languageCode": F.when(F.col("l_linenumber") % 2 == 1, "en").otherwise("sv"),
        "typeId": F.when(F.col("l_linenumber") == 1, FULLY_SPECIFIED_NAME).otherwise(SYNONYM),
        "caseSignificanceId": F.lit(900000000000448009),
    }


def _relationships(concepts: DataFrame, *more: str) -> DataFrame:
    k = F.col("k")
    parents = F.array(
        F.struct(F.lit(0).alias("j"), F.expr("(k - 1) div 8").alias("parent")),
        F.struct(F.lit(1).alias("j"), F.expr("(k - 1) div 5").alias("parent")),
    )
    return (
        concepts.withColumn("k", F.expr(f"id div {PLACE}"))
        .where("k > 0")
        .select(
            F.col("id").alias("sourceId"),
            "effectiveTime",
            "active",
            "moduleId",
            "k",
            *more,
            F.inline(parents),
        )
        .where("j = 0 OR k % 3 = 0")
        .select(
            (
                (k * 10 + F.col("j")) * PLACE + F.when(k % 4 < 3, 1000052126).otherwise(26)
            ).alias("id"),
            "effectiveTime",
            "active",
            "moduleId",
            "sourceId",
            _concept_id(F.col("parent")).alias("destinationId"),
            F.lit(0).cast("smallint").alias("relationshipGroup"),
            F.lit(IS_A).alias("typeId"),
            F.lit(900000000000011006).alias("characteristicTypeId"),
            F.lit(900000000000451002).alias("modifierId"),
            *more,
        )
    )


def _languagerefsets(lines: DataFrame) -> DataFrame:
    return lines.where("l_suppkey % 5 <> 0").select(
        F.concat_ws(
            "-",
            F.lit("lr"),
            "l_orderkey",
            "l_linenumber",
            F.col("l_suppkey") % 6,
            F.col("l_partkey") % 2,
        ).alias("id"),
        _release_of("l_shipdate").alias("effectiveTime"),
        _flag(F.col("l_discount") > 0.02).alias("active"),
        _description_id().alias("referencedComponentId"),
        F.when(F.col("l_quantity") >= 25, PREFERRED).otherwise(ACCEPTABLE).alias("acceptabilityId"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


def _of_languagerefsets() -> dict[str, Column]:
    return {"moduleId": _line_module(), "refsetId": _concept_id(F.col("l_suppkey") % 6)}


def _simplerefsets(orders: DataFrame) -> DataFrame:
    group = F.col("o_custkey") % 12
    key = F.col("o_orderkey")
    return orders.select(
        F.concat(F.lit("sr-"), _half("o_orderkey")).alias("id"),
        _release_of("o_orderdate").alias("effectiveTime"),
        _flag(F.col("o_orderpriority") != "5-LOW").alias("active"),
        F.lit(EXTENSION_MODULE).alias("moduleId"),
        _concept_id(F.when(group == 11, 90000000).otherwise(group)).alias("refsetId"),
        F.when(group == 5, (key * 10 + 1) * PLACE + 1000052113)
        .otherwise(_concept_id(_half("o_orderkey")))
        .alias("referencedComponentId"),
        "o_orderkey",
    )


def _refsetdescriptors(nations: DataFrame) -> DataFrame:
    return nations.where("n_nationkey % 3 <> 1").select(
        F.concat(F.lit("rd-"), "n_nationkey").alias("id"),
        F.lit(20000531).alias("effectiveTime"),
        F.lit(1).alias("active"),
        F.lit(EXTENSION_MODULE).alias("moduleId"),
        F.lit(900000000000456007).alias("refsetId"),
        _concept_id(F.col("n_nationkey").cast("bigint")).alias("referencedComponentId"),
        F.lit(449608002).cast("bigint").alias("attributeDescription"),
        F.lit(900000000000461009).alias("attributeType"),
        F.lit(0).alias("attributeOrder"),
    )


def _owlrefsets(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.concat(F.lit("ow-"), "o_orderkey").alias("id"),
        _release_of("o_orderdate").alias("effectiveTime"),
        _flag(F.col("o_orderstatus") != "F").alias("active"),
        F.lit(EXTENSION_MODULE).alias("moduleId"),
        F.lit(733073007).cast("bigint").alias("refsetId"),
        _concept_id(_half("o_orderkey")).alias("referencedComponentId"),
        F.concat(F.lit("SubClassOf(:"), "o_custkey", F.lit(")")).alias("owlExpression"),
    )


#: Columns that follow from others of a row, made after rows are ranked.
_LATER = {"descriptions": _of_descriptions, "languagerefsets": _of_languagerefsets}
