"""Cohort tables: row filters, coded samples, pulled metadata merged from several sources, depth fill-in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbiome.functions import coerce, text
from fieldbiome.operators.abundance import two_level_sum

# Codes of treatment lines and of campaigns before and after the upgrade.
TREATMENT_LINES = {"OUT WWTP": 0, "AOP": 1, "CW": 1, "GAC": 1}
CAMPAIGNS = {"C2-I": 0, "C5-I": 0, "C10-I": 1, "C12-I": 1}


def rows_of_environment(metadata: DataFrame, environment: str = "wastewater") -> DataFrame:
    """Rows of an environment (whatever its case) with an id that isn't blank."""
    return metadata.where((F.lower(F.trim("environment")) == environment) & (F.trim("sample_id") != ""))


def deep_enough(metadata: DataFrame, least: int = 200_000) -> DataFrame:
    """Rows of at least `least` reads, read_count as a number; rows whose count can't be read go. If none is left, the query that
    reads the result raises: a second branch of the plan, without rows, counts them."""
    kept = metadata.withColumn("read_count", coerce.count_or_null(F.col("read_count").cast("string"))).where(F.col("read_count") >= least)
    none = F.when(F.col("__n") == 0, F.raise_error(F.lit(f"no sample has {least} reads")).cast("boolean")).otherwise(F.lit(False))
    guard = kept.agg(F.count("*").alias("__n")).where(none)
    return kept.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema.fields]))


def coded_rows(rows: DataFrame, treatments: dict[str, int] | None = None, campaigns: dict[str, int] | None = None) -> DataFrame:
    """(sample_id, arg_total, treatment, time, plant_id, campaign) of rows (sample, campaign, gene, concentration).

    Samples and campaigns outside the code tables go; replicates are averaged by gene, genes summed. What is no number is skipped.
    """
    code = lambda m, c: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.trim(c)]
    named = rows.select(F.trim("sample").alias("sample"), F.trim("campaign").alias("campaign"), F.trim("gene").alias("gene"), coerce.float_or_null(F.col("concentration").cast("string")).alias("v"))
    coded = named.withColumn("treatment", code(treatments or TREATMENT_LINES, F.col("sample"))).withColumn("time", code(campaigns or CAMPAIGNS, F.col("campaign"))).where("treatment is not null and time is not null")
    total = two_level_sum(coded, ["sample", "campaign", "treatment", "time"], "gene", "v")
    plant = F.replace("sample", F.lit(" "), F.lit("_"))
    return total.select(F.concat_ws("_", plant, "campaign").alias("sample_id"), "arg_total", "treatment", "time", plant.alias("plant_id"), "campaign")


def with_depth(panel: DataFrame, depth: DataFrame, key: str = "sample_id", column: str = "sequencing_depth") -> DataFrame:
    """panel with a depth from its own column, or else from depth (key, read_count). Repeated keys of depth repeat rows."""
    joined = panel.join(depth.select(key, F.col("read_count").alias("__depth")), key, "left")
    own = F.col(column) if column in panel.columns else F.lit(None).cast("double")
    return joined.withColumn(column, F.coalesce(own.cast("double"), F.col("__depth").cast("double"))).drop("__depth")


def pulled_metadata(runs: DataFrame, archive: DataFrame, run_table: DataFrame, samples: DataFrame) -> DataFrame:
    """runs (run_id) with collection date, location, alias and plant id, by the first source that isn't blank.

    archive (run_id, collection_date, country, location, sample_alias), run_table (run_id, fields: map), samples (run_id,
    attributes: map); each may lack a run.
    """
    joined = runs.join(archive, "run_id", "left").join(run_table, "run_id", "left").join(samples, "run_id", "left")
    field = lambda m, k: F.try_element_at(m, F.lit(k))
    date = coerce.first_non_blank(F.col("collection_date"), field("attributes", "collection_date"), field("attributes", "collection date"), field("fields", "ReleaseDate"))
    place = coerce.first_non_blank(F.col("location"), F.col("country"), field("attributes", "geo_loc_name"), field("attributes", "geographic location"), field("attributes", "lat_lon"), field("attributes", "isolation_source"))
    alias = coerce.first_non_blank(F.col("sample_alias"), field("fields", "SampleName"))
    plant = text.slug(F.when(alias != "", alias).otherwise(place))
    return joined.select("run_id", date.alias("collection_date"), place.alias("location"), alias.alias("sample_alias"), plant.alias("plant_id"))


def sparse_rows(pulled: DataFrame) -> DataFrame:
    """The number of rows without date, location and alias."""
    return pulled.agg(F.count_if((F.col("collection_date") == "") & (F.col("location") == "") & (F.col("sample_alias") == "")).alias("n_sparse"))


def enough_sequences(lines: DataFrame, least: int = 20) -> DataFrame:
    """(n, enough) of the FASTA records in lines (value): a guard against made-up inputs."""
    return lines.agg(F.count_if(F.col("value").startswith(">")).alias("n")).withColumn("enough", F.col("n") >= least)


def wanted_rows(df: DataFrame, columns: list[str], tokens: list[str], source_column: str, source: str) -> DataFrame:
    """Rows of a source any of whose columns holds any of the tokens (wildcards joined by OR)."""
    hit = F.lit(False)
    for token in tokens:
        hit = hit | text.any_contains([F.col(c) for c in columns], token)
    return df.where(hit & (F.col(source_column) == source))
