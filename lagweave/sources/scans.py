"""File scans, conforming and sinks."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lagweave.functions.paths import normalize_path
from lagweave.functions.scores import clamp01, norm_score, parse_decimal_comma

SEPARATORS = [",", ";", "\t", "|"]
SCHEMA_VARS = ["code", "role", "label", "ontology_id", "conf", "freq_hint"]


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared folder of the cluster, or a local one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="lagweave-io-")
    return f"{shared.rstrip('/')}/lagweave-io-{uuid.uuid4().hex}"


def _separators(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files behind a path by the separator of their header line: the first of , ; tab | that it holds. Only the first
    line of each file leaves the tasks."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).where("at = 0").withColumn(
        "line", F.monotonically_increasing_id())
    heads = lines.groupBy("file").agg(F.min_by("value", "line").alias("head"))
    found = F.coalesce(*[F.when(F.contains("head", F.lit(s)), F.lit(s)) for s in SEPARATORS], F.lit(SEPARATORS[0]))
    out: dict[str, list[str]] = {}
    for r in heads.select("file", found.alias("sep")).orderBy("file").collect():
        out.setdefault(r["sep"], []).append(unquote(r["file"]))
    return out


def _scan(spark: SparkSession, path: str, schema: str | None) -> DataFrame | None:
    """All files with their name in `_file`, each read with its own separator."""
    out = None
    for sep, files in _separators(spark, path).items():
        reader = spark.read.option("sep", sep).option("header", True)
        part = (reader.schema(schema).csv(files) if schema else reader.csv(files)).select("*", F.col("_metadata.file_path").alias("_file"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def scan_delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV files below a path; every file is split by the first of , ; tab | that its own header line holds. Columns that
    only some files have are null elsewhere. Without a file the given schema, or no column, is returned empty."""
    found = _scan(spark, path, schema)
    return spark.createDataFrame([], schema or "") if found is None else found.drop("_file")


def scan_profiles(spark: SparkSession, root: str, filename: str, pattern: str = "", max_profiles: int | None = None, schema: str | None = None) -> DataFrame:
    """Every <root>/<profile>/<filename> with the profile taken from the folder; substring filter and cap by name."""
    found = _scan(spark, f"{root}/*/{filename}", schema)
    if found is None:
        return spark.createDataFrame([], f"{schema}, profile_id string" if schema else "profile_id string")
    profile = F.regexp_extract("_file", r"([^/]+)/[^/]+(?:/[^/]+)?$", 1) if filename.endswith("/") else F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    out = found.withColumn("profile_id", profile).drop("_file").where(F.col("profile_id").contains(pattern))
    if max_profiles is None:
        return out
    kept = out.select("profile_id").distinct().orderBy("profile_id").limit(max_profiles)
    return out.join(kept, "profile_id", "left_semi")


def conform_wide(df: DataFrame, order: str, variables: list[str], start: str = "2025-01-01") -> DataFrame:
    """Expected columns in order, null where the upload lacks one, with t_index and date made from the row position."""
    from lagweave.core.ranking import number_rows

    numbered = number_rows(df, ["profile_id"], order, "_t")
    have = set(df.columns)
    t = F.col("t_index").cast("long") if "t_index" in have else F.col("_t").cast("long")
    date = F.col("date").cast("date") if "date" in have else F.date_add(F.lit(start).cast("date"), t.cast("int"))
    cols = [(F.col(v).try_cast("double") if v in have else F.lit(None).cast("double")).alias(v) for v in variables]
    return numbered.select("profile_id", t.alias("t_index"), date.alias("date"), *cols)


def wide_to_long(wide: DataFrame, metadata: DataFrame, variables: list[str]) -> DataFrame:
    """One row per (profile, slot, variable) with its metadata; unknown codes keep null metadata."""
    melted = wide.unpivot(["profile_id", "t_index", "date"], variables, "code", "value")
    return melted.join(metadata.where(F.col("code").isin(variables)).select(*SCHEMA_VARS), "code", "left")


def variable_roles(codes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Role per code from metadata keywords, else from the code's first letter."""
    m = metadata.groupBy("code").agg(F.min(F.lower("role")).alias("_r"))
    j = codes.select("code").distinct().join(m, "code", "left")
    role = (F.when(F.col("_r").contains("pred"), "PREDICTOR").when(F.col("_r").contains("crit"), "CRITERION")
            .when(F.col("code").startswith("P"), "PREDICTOR").when(F.col("code").startswith("C"), "CRITERION").otherwise("UNKNOWN"))
    return j.select("code", role.alias("role"), F.col("_r").isNotNull().alias("from_metadata"))


def load_rank_lists(wide: DataFrame, max_global: int, top_k: int, dup: str = "max") -> DataFrame:
    """Wide rank lists (global_001_path_full | _path_embedtext | _path_lextext, global_001_score) to long rows; the
    first non-empty path column counts, ranks past the computed depth are cut, repeated paths keep the max or mean."""
    n = min(max_global, top_k)
    slots = []
    for i in range(1, n + 1):
        names = [f"global_{i:03d}_path_{s}" for s in ("full", "embedtext", "lextext")]
        have = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in wide.columns]
        if have and f"global_{i:03d}_score" in wide.columns:
            slots.append(F.struct(F.lit(i).alias("rank"), F.coalesce(*have, F.lit(None).cast("string")).alias("path"), F.col(f"global_{i:03d}_score").try_cast("double").alias("score")))
    limit = F.coalesce(F.col("global_top_n_computed").try_cast("int"), F.lit(n)) if "global_top_n_computed" in wide.columns else F.lit(n)
    rows = wide.select("run_id", "profile_id", limit.alias("_n"), F.explode(F.array(*slots)).alias("s")).select("run_id", "profile_id", "_n", "s.*").where("path is not null and score is not null and rank <= _n")
    agg = F.max("score") if dup == "max" else F.avg("score")
    return rows.groupBy("run_id", "profile_id", "path").agg(F.min("rank").alias("rank"), agg.alias("score"))


def load_mapping_ranks(df: DataFrame, profile: str | None = None) -> DataFrame:
    required = ["profile_id", "part", "criterion_path", "criterion_leaf", "rank", "predictor_path", "relevance_score"]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = df if profile is None else df.where(F.col("profile_id") == profile)
    out = rows.select("profile_id", F.trim("part").alias("part"), normalize_path(F.col("criterion_path")).alias("criterion_path"), normalize_path(F.col("criterion_leaf")).alias("criterion_leaf"),
                      F.col("rank").try_cast("int").alias("rank"), normalize_path(F.col("predictor_path")).alias("predictor_path"), norm_score(F.col("relevance_score").try_cast("double")).alias("score"))
    return out.where("predictor_path != '' and score is not null")


def explode_evaluations(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs(key, json) of dimension -> module -> feature -> score: one row per score with its dotted column name."""
    nested = F.from_json("json", "map<string,map<string,map<string,string>>>")
    d = docs.select(key, F.explode(nested).alias("dimension", "m")).select(key, "dimension", F.explode("m").alias("module", "f"))
    out = d.select(key, "dimension", "module", F.explode("f").alias("feature", "raw"))
    return out.select(key, "dimension", "module", "feature", F.col("raw").try_cast("double").alias("score"), F.concat_ws(".", "dimension", "module", "feature").alias("column"))


def upsert_by_hash(existing: DataFrame, new: DataFrame, hash_col: str, order: str) -> DataFrame:
    """Add rows whose hash is not present yet; of repeated hashes among the new rows the last by `order` stays."""
    fresh = new.join(existing.select(hash_col).distinct(), hash_col, "left_anti").select(*new.columns)
    last = fresh.groupBy(hash_col).agg(F.max_by(F.struct(*[c for c in new.columns if c != hash_col]), order).alias("r")).select(hash_col, "r.*")
    return existing.unionByName(last.select(*existing.columns))


def append_history(rows: DataFrame, path: str) -> None:
    """Append run rows to a ledger partitioned by run."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def write_matrix(edges: DataFrame, left: str, right: str, rights: list, path: str) -> None:
    from lagweave.operators.mapping import densify

    densify(edges, left, right, rights).write.mode("overwrite").parquet(path)


def scan_text_blocks(lines: DataFrame, header: str, order: str = "line_no") -> DataFrame:
    """lines(doc_id, line_no, text): a line matching `header` opens a block; the block's other lines, without quotes
    and empty lines, form its body. A document's lines are one ordered window."""
    text = F.trim(F.regexp_replace("text", "^[\"']+|[\"']+$", ""))
    is_head = F.col("text").rlike(header)
    w = W.partitionBy("doc_id").orderBy(order)
    tagged = lines.withColumns({"clean": text, "head": is_head}).withColumn("block", F.sum(F.col("head").cast("int")).over(w)).where("block > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head") & (F.col("clean") != ""), F.struct(order, "clean")))), lambda s: s["clean"]), "\n")
    return tagged.groupBy("doc_id", "block").agg(F.max(F.when(F.col("head"), F.col("clean"))).alias("header"), body.alias("body")).where("body != ''")


MODEL = ("variables array<struct<var_id string, role string, label string>>, edges array<struct<source string, target string, score double>>, "
         "relevance array<struct<predictor string, criterion string, score string>>")


def explode_models(docs: DataFrame) -> dict[str, DataFrame]:
    """docs(model_id, json) -> variables, edges by kind (PC, PP, CC), dense relevance with comma decimals parsed."""
    m = docs.select("model_id", F.from_json("json", MODEL).alias("m"))
    variables = m.select("model_id", F.inline("m.variables"))
    edges = m.select("model_id", F.inline("m.edges"))
    role = lambda c: variables.select("model_id", F.col("var_id").alias(c), F.substring("role", 1, 1).alias(f"{c}_role"))
    kind = edges.join(role("source"), ["model_id", "source"], "left").join(role("target"), ["model_id", "target"], "left").select(
        "model_id", "source", "target", "score", F.concat("source_role", "target_role").alias("kind"))
    rel = m.select("model_id", F.inline("m.relevance")).select("model_id", "predictor", "criterion", clamp01(parse_decimal_comma(F.col("score"))).alias("score"))
    return {"variables": variables, "edges": kind, "relevance": rel}


def write_rank_lists(ranks: DataFrame, depth: int, path: str | None = None) -> DataFrame:
    """Wide view global_001_path / global_001_score … of long rank rows; written when a path is given."""
    wide = ranks.where(F.col("rank") <= depth).groupBy("run_id", "profile_id").pivot("rank", list(range(1, depth + 1))).agg(F.first("path").alias("path_full"), F.first("score").alias("score"))
    named = wide.select("run_id", "profile_id", *[F.col(f"{i}_{c}").alias(f"global_{i:03d}_{c}") for i in range(1, depth + 1) for c in ("path_full", "score")])
    if path is not None:
        named.write.mode("overwrite").parquet(path)
    return named


def validate_model(variables: DataFrame, edges: DataFrame, design: DataFrame) -> DataFrame:
    """Violations (model_id, rule, n): empty or repeated ids, missing, repeated, self or out-of-range pairs, and too
    few observations for the number of variables."""
    ids = variables.groupBy("model_id", "var_id").agg(F.count(F.lit(1)).alias("n"))
    rule = lambda df, name: df.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(name))
    a = variables.where("role = 'PREDICTOR'").select("model_id", F.col("var_id").alias("source"))
    b = variables.where("role = 'CRITERION'").select("model_id", F.col("var_id").alias("target"))
    pairs = edges.groupBy("model_id", "source", "target").agg(F.count(F.lit(1)).alias("n"))
    grid = a.join(b, "model_id").distinct()
    k = variables.groupBy("model_id").agg(F.count_distinct("var_id").alias("k")).join(design, "model_id")
    parts = [
        rule(variables.where(F.trim(F.coalesce("var_id", F.lit(""))) == ""), "empty_id"), rule(ids.where("n > 1 and trim(var_id) != ''"), "duplicate_id"),
        rule(grid.join(pairs, ["model_id", "source", "target"], "left_anti"), "missing_pair"), rule(pairs.where("n > 1"), "duplicate_pair"),
        rule(edges.where("source = target"), "self_pair"), rule(edges.where("score < 0 or score > 1 or score is null"), "score_range"),
        rule(k.where("total_observations < 3 * k"), "observations_under_3k"), rule(k.where("total_observations < 5 * k"), "observations_under_5k")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_grid(variables: DataFrame, edges: DataFrame) -> DataFrame:
    """model_id, kind (PC, PP, CC), n_expected, n_present, n_missing: how full each model's grids of ordered pairs of
    different variables are. The expected pairs follow from the numbers of variables, so no grid is built."""
    v = variables.where(F.trim("var_id") != "").select("model_id", "var_id", F.upper(F.substring("role", 1, 1)).alias("r")).distinct()
    sizes = v.groupBy("model_id").agg(F.count_if(F.col("r") == "P").alias("p"), F.count_if(F.col("r") == "C").alias("c"))
    end = lambda name: v.select("model_id", F.col("var_id").alias(name), F.col("r").alias(f"{name}_r"))
    pairs = edges.where("source <> target").select("model_id", "source", "target").distinct().join(end("source"), ["model_id", "source"]).join(end("target"), ["model_id", "target"])
    kind = F.concat("source_r", "target_r")
    seen = pairs.groupBy("model_id").agg(*[F.count_if(kind == k).alias(k) for k in ("PC", "PP", "CC")])
    full = {"PC": F.col("p") * F.col("c"), "PP": F.col("p") * (F.col("p") - 1), "CC": F.col("c") * (F.col("c") - 1)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("n_expected"), F.coalesce(k, F.lit(0)).alias("n_present")) for k, n in full.items()]))
    return sizes.join(seen, "model_id", "left").select("model_id", rows.alias("x")).select("model_id", "x.*", (F.col("x.n_expected") - F.col("x.n_present")).alias("n_missing"))


def design_coherence(design: DataFrame) -> DataFrame:
    """Days >= 7, prompts >= 1; under 30 observations the diary is enabled, then prompts are raised; derived totals."""
    days, prompts = F.greatest(F.lit(7), F.coalesce("study_days", F.lit(7))), F.greatest(F.lit(1), F.coalesce("prompts_per_day", F.lit(1)))
    first = design.withColumns({"study_days": days.cast("int"), "prompts_per_day": prompts.cast("int"), "diary": F.coalesce("diary", F.lit(False))})
    few = F.col("study_days") * F.col("prompts_per_day") + F.when(F.col("diary"), F.col("study_days")).otherwise(0) < 30
    second = first.withColumn("diary", F.col("diary") | few)
    still = second.withColumn("prompts_per_day", F.when(
        F.col("study_days") * F.col("prompts_per_day") + F.when(F.col("diary"), F.col("study_days")).otherwise(0) < 30,
        F.greatest(F.col("prompts_per_day"), F.ceil((30 - F.col("study_days")) / F.col("study_days")).cast("int"))).otherwise(F.col("prompts_per_day")))
    totals = still.withColumn("expected_prompts", F.col("study_days") * F.col("prompts_per_day")).withColumn("expected_entries", F.when(F.col("diary"), F.col("study_days")).otherwise(0))
    total = F.col("expected_prompts") + F.col("expected_entries")
    return totals.withColumn("minimum_target", F.least(total, F.greatest(F.lit(30), F.coalesce("minimum_target", F.lit(30))))).withColumn("total_observations", total)


def collection_schema(variables: DataFrame) -> DataFrame:
    """Scale range from the response text, baseline by role and polarity, question and prompts per day."""
    compact = F.regexp_replace(F.lower(F.coalesce("response_scale", F.lit(""))), r"\s", "")
    pat = r"(-?\d+(?:[.,]\d+)?)(?:-|to|–)(-?\d+(?:[.,]\d+)?)"
    num = lambda g: parse_decimal_comma(F.regexp_extract(compact, pat, g))
    lo, hi = num(1), num(2)
    found = lo.isNotNull() & hi.isNotNull()
    low = F.when(found, F.least(lo, hi)).otherwise(0.0)
    high = F.when(found, F.when(lo == hi, hi + 1).otherwise(F.greatest(lo, hi))).when(compact.contains("%"), 100.0).otherwise(9.0)
    base = (F.when(F.upper("role") == "PREDICTOR", 0.55).when(F.lower("polarity") == "higher_is_worse", 0.65).when(F.lower("polarity") == "higher_is_better", 0.35).otherwise(0.50))
    return variables.withColumns({"scale_min": low, "scale_max": high, "baseline": base, "question": F.coalesce(F.nullif(F.trim("item"), F.lit("")), F.col("label")), "prompts_per_day": F.greatest(F.lit(1), F.coalesce("sampling_per_day", F.lit(1)))})


# Keyword rules of the fine domains, tested in this order.
DOMAIN_KEYWORDS = {
    "bio_procedure": [
        "electroconvulsive", "ect", "transcranial magnetic", "tms", "transcranial direct", "tdcs", "deep brain stimulation", "dbs",
        "vagus nerve stimulation", "vns", "neurostimulation", "neuromodulation", "light therapy", "phototherapy",
    ],
    "psycho": [
        "psychotherapy", "therapy", "counsel", "counselling", "cognitive behavioral", "cognitive-behavioral", "cbt", "dialectical", "dbt",
        "acceptance and commitment", "act", "interpersonal therapy", "ipt", "exposure", "emdr", "psychoeducation",
        "motivational interviewing", "mindfulness-based", "mbct", "mbsr",
    ],
    "social": [
        "supported employment", "housing", "case management", "assertive community", "community treatment", "social support", "peer support",
        "family therapy", "family intervention", "multifamily", "social skills training", "vocational", "school", "education",
        "rehabilitation", "occupational", "financial assistance",
    ],
    "lifestyle": [
        "exercise", "physical activity", "sleep", "sleep hygiene", "diet", "nutrition", "weight", "yoga", "meditation", "relaxation",
        "breathing", "mindfulness", "stress management",
    ],
    "bio_pharm": ["antidepress", "antipsych", "ssri", "snri", "benzodia", "mood stabil", "lithium", "valpro", "lamotrig"],
}


def classify_label(label: Column, is_medication: Column, is_therapy: Column, keywords: dict[str, list[str]] = DOMAIN_KEYWORDS) -> Column:
    """Struct of the fine domain, the four-way domain and the treatment type; flags come before keywords."""
    fine = F.when(is_medication, "bio_pharm").when(is_therapy, "psycho")
    for name, words in keywords.items():
        fine = fine.when(F.lower(label).rlike("|".join(words)), name)
    fine = fine.otherwise("other")
    wide = F.when(fine.isin("bio_pharm", "bio_procedure"), "BIO").when(fine == "psycho", "PSYCHO").when(fine == "social", "SOCIAL").otherwise("X")
    kind = (F.when(fine == "bio_pharm", "medication").when(fine == "bio_procedure", "biological_procedure").when(fine == "psycho", "psychotherapy").when(fine == "social", "psychosocial").otherwise("other"))
    return F.struct(fine.alias("fine"), wide.alias("domain"), kind.alias("category"))
