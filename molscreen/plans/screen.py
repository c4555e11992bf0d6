"""The whole screen: text in, ranked and qualified molecules out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from molscreen.functions.bits import classify
from molscreen.functions.validate import destandardise, sigmoid, withhold, withhold_reason
from molscreen.operators import canonical, descriptors, model, molgraph, rank, similarity, smiles
from molscreen.schemas import CATEGORY_WEIGHTS, CHECKPOINT_ROWS, CURVES, ENDPOINTS
from molscreen.session import broadcast_if_small, materialise

# Own choice: (mean, sd) that turns a raw regression output into its physical range.
SCALES = {"caco2": (-5.0, 0.5), "ppbr": (85.0, 10.0), "vdss": (2.0, 1.5), "half_life": (12.0, 8.0), "clearance": (40.0, 25.0)}


def identify(rows: DataFrame, column: str) -> DataFrame:
    """Every distinct input text once: (smiles, canonical_smiles, mol_key, error_code, position).

    Duplicates collapse before any parsing, on both sides of the shuffle, so a text that
    fills a third of the table costs as much as any other.
    """
    distinct = rows.select(F.col(column).alias("smiles")).distinct().select(F.md5("smiles").alias("_digest"), "smiles")
    keyed = canonical.canonicalise(molgraph.perceive(smiles.parse(distinct, "_digest", "smiles", distinct_texts=True)))
    return keyed.select("smiles", "canonical_smiles", "mol_key", "had_salts", "error_code", "position")


def molecules(identified: DataFrame) -> DataFrame:
    """Every distinct molecule once, from its canonical text: graph and descriptors.

    Salts are gone by then and atoms stand in one order, so all spellings of a molecule
    get the same features, fingerprint and score, bit for bit.
    """
    distinct = identified.where(F.col("mol_key").isNotNull()).groupBy("mol_key").agg(
        F.min("canonical_smiles").alias("canonical_smiles")
    )
    return descriptors.add_descriptors(molgraph.perceive(smiles.parse(distinct, "mol_key", "canonical_smiles", distinct_texts=True)))


def screen(
    rows: DataFrame,
    references: DataFrame,
    structure: str = "smiles",
    weights: dict | None = None,
    model_version: str = "untrained-0",
    stored: DataFrame | None = None,
) -> DataFrame:
    """Score every row; a row that does not parse keeps its error and gets no score.

    ``references`` has (ref_id, words).  ``stored`` may hold earlier outputs as (mol_key,
    model_version, outputs): those molecules skip the model.
    """
    spark = rows.sparkSession
    # read twice below, and much smaller than what it takes to compute
    identified = materialise(identify(rows, structure), "identified")
    mols = molecules(identified)
    if stored is not None:
        current = stored.where(F.col("model_version") == model_version)
        # rows stored twice count once, the later spelling of the array deciding
        known = current.groupBy("mol_key").agg(F.max("outputs").alias("_known"))
        mols = mols.join(known, "mol_key", "left")
    else:
        mols = mols.withColumn("_known", F.lit(None).cast("array<double>"))
    cached = F.col("_known").isNotNull()
    fresh = model.predict(spark, weights or model.seeded_weights(), skip=cached)
    mols = mols.withColumn("_fresh", fresh).withColumn("cached", cached)
    if similarity.small_enough(references):
        mols = mols.withColumn("similarity", similarity.similarity_column(references))
    else:
        valid = mols.where(F.col("words").isNotNull()).select(F.col("mol_key").alias("query_id"), "words")
        near = similarity.mean_top_n(similarity.nearest(valid, references)).select(
            F.col("query_id").alias("mol_key"), "similarity"
        )
        mols = mols.join(near, "mol_key", "left")
    mols = mols.withColumn("outputs", F.coalesce("_known", "_fresh"))
    # a probability for binary endpoints, a physical quantity for the others
    values = []
    for i, (code, _, _, task, _) in enumerate(ENDPOINTS):
        raw = F.get("outputs", F.lit(i))
        values.append(sigmoid(raw) if task == "binary" else destandardise(raw, *map(F.lit, SCALES[code])))
    curves = [(c, *CURVES[c], CATEGORY_WEIGHTS[cat]) for c, _, cat, _, _ in ENDPOINTS]
    scored = (
        mols.withColumn("values", F.when(F.col("outputs").isNotNull(), F.array(*values)))
        .withColumn("status", F.when(F.col("similarity").isNotNull(), classify(F.col("similarity"))))
        .withColumn("raw_score", rank.triage_wide(F.col("values"), curves))
    )
    per_molecule = scored.select(
        "mol_key", F.col("n_atoms").alias("heavy_atoms"), "mol_weight", "tpsa", "hbd", "hba", "rotatable_bonds", "ring_count",
        "values", "similarity", "status",
        withhold(F.col("raw_score"), F.col("status")).alias("triage_score"),
        withhold_reason(F.col("status")).alias("withheld"), "cached",
    )
    per_text = identified.join(per_molecule, "mol_key", "left").select(
        F.col("smiles").alias("_structure"), "canonical_smiles", "had_salts", *per_molecule.columns, "error_code", "position",
        smiles.error_text(F.col("smiles"), F.col("error_code"), F.col("position")).alias("error_detail"),
        F.lit(model_version).alias("model_version"),
    )
    # null structures are rows too: they report empty input
    return rows.join(per_text, F.col(structure).eqNullSafe(F.col("_structure")), "left").drop("_structure")


def explain_values(screened: DataFrame, key: str) -> DataFrame:
    """Tall view: one row per molecule and endpoint, with the desirability behind the score."""
    from molscreen.functions.desirability import by_shape
    from molscreen.schemas import endpoint_registry

    reg = endpoint_registry(screened.sparkSession)  # twelve rows
    tall = screened.where(F.col("values").isNotNull()).select(key, F.posexplode("values").alias("output_index", "value"))
    j = tall.join(broadcast_if_small(reg), "output_index")
    d = by_shape(F.col("value"), F.col("shape"), F.col("low"), F.col("high"))
    return j.select(key, F.col("code").alias("endpoint"), "category", "task", "value", d.alias("desirability"), "weight")


def ranking(screened: DataFrame, k: int, row_index: str = "row_index") -> DataFrame:
    """Best ``k`` scored rows; rows without a score are not candidates."""
    scored = screened.where(F.col("triage_score").isNotNull())
    order = rank.score_order("triage_score", "mol_key", row_index)
    return rank.with_rank(rank.top_k(scored, k, "triage_score", "mol_key", row_index), order)


def import_library(
    spark, path: str, out: str, references: DataFrame, smiles_column: str = "smiles", skip_invalid: bool = True,
    progress_every: int = CHECKPOINT_ROWS, on_progress=None,
) -> DataFrame:
    """Score a library CSV and write the results; returns the completed and failed counts.

    One write holds all rows, in folders ``scored`` and ``rejected``; invalid rows keep their
    reason, without ``skip_invalid`` all go to ``scored``.  The counts are observed while it runs
    and nothing is read again.  Every task reports its rows in steps of ``progress_every`` to two
    accumulators; ``on_progress(done, failed)`` is called with what has arrived whenever another
    step is complete, and once at the end with the exact counts.
    """
    from molscreen.operators.clean import require_columns
    from molscreen.sources.files import CAVEAT

    if progress_every < 1:
        raise ValueError("progress_every must be positive")
    rows = require_columns(spark.read.csv(path, header=True, mode="PERMISSIVE", escape='"'), [smiles_column])
    flat = screen(rows, references, smiles_column).withColumn("values", F.array_join("values", " ")).withColumn("caveat", F.lit(CAVEAT))
    bad = F.col("error_code").isNotNull()
    side = F.when(bad, "rejected").otherwise("scored") if skip_invalid else F.lit("scored")
    seen = Observation("import")
    placed = flat.withColumn("part", side).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("failed"))
    done, failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def count(batches):
        # a task that runs again reports again: progress may run ahead, the counts at the end do not
        n = m = 0
        for batch in batches:
            n, m = n + batch.num_rows, m + batch.num_rows - batch.column("error_code").null_count
            while n >= progress_every:
                done.add(progress_every)
                failed.add(m)
                n, m = n - progress_every, 0
            yield batch
        done.add(n)
        failed.add(m)

    writer = placed.mapInArrow(count, placed.schema).write.mode("errorifexists").partitionBy("part").option("header", True).option("escape", '"')
    if on_progress is None:
        writer.csv(out)
    else:
        _watched(spark, lambda: writer.csv(out), lambda: (done.value, failed.value), progress_every, on_progress)
    n, wrong = seen.get["n"], seen.get["failed"]
    if on_progress is not None:
        on_progress(n, wrong)
    return spark.createDataFrame([(n if not skip_invalid else n - wrong, wrong if skip_invalid else 0)], "completed bigint, failed bigint")


def _watched(spark, job, now, every: int, report) -> None:
    """Run ``job`` and report (done, failed) whenever another ``every`` rows are done."""
    with ThreadPoolExecutor(1) as pool:
        running, told = pool.submit(inheritable_thread_target(spark)(job)), 0
        while not running.done():
            wait([running], timeout=0.1)
            done, failed = now()
            if done // every > told // every:
                report(done, failed)
                told = done
        running.result()
