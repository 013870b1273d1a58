"""The journal of claims, trials and verdicts: an append-only table whose batches are chained by hashes.

Rows are JSON lines below a folder, written through a DataFrame, so any number of trials of any
number of sessions goes in at once. Each append is a batch; a batch names the digest of the one
before. A row's mark is a hash of all its content and place, a batch's digest is made from
the sum of its rows' marks and their number, and a claim is filed under the hash of its own text.
`faults` computes all of these again in one plan: a changed, removed or added row shows up in its
own batch and in the chain. A trial without a claim registered before it is refused by an anti
join. One session appends at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import PreregistrationError
from lattica.functions.preregistration import Hypothesis, Verdict, Violation

CLAIM, TRIAL, VERDICT = "claim", "trial", "verdict"
_SCHEMA = "batch int, parent string, kind string, at timestamp, fingerprint string, content string, notes string, mark string"
FIRST = "0" * 16


def _mark() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("batch", "parent", "kind", "fingerprint", "content", "notes")]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _digest(mark: Column) -> Column:
    """Of all rows of a batch, in any order: partial sums, no list."""
    return F.substring(F.sha2(F.concat_ws(":", F.sum(F.xxhash64(mark).cast("decimal(38,0)")).cast("string"), F.count("*").cast("string")), 256), 1, 16)


class Journal:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        """Everything that was appended; a line that is no row of the journal has no kind."""
        try:
            return self.spark.read.schema(_SCHEMA).json(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _SCHEMA)

    def _append(self, kind: str, rows: DataFrame) -> None:
        """rows: fingerprint, content (JSON) and notes."""
        last = self.rows().groupBy("batch").agg(_digest(F.col("mark")).alias("digest")).orderBy(F.desc("batch")).limit(1).collect()
        number, parent = (last[0].batch + 1, last[0].digest) if last else (0, FIRST)
        named = rows.select(F.lit(number).alias("batch"), F.lit(parent).alias("parent"), F.lit(kind).alias("kind"), F.current_timestamp().alias("at"), "fingerprint", "content", "notes")
        named.withColumn("mark", _mark()).write.mode("append").json(self.folder)

    def register(self, *claims: Hypothesis) -> list[str]:
        """Files the claims that are not filed yet; notes are no part of what is hashed."""
        there = {r.fingerprint for r in self.claims().where(F.col("fingerprint").isin([c.fingerprint for c in claims])).select("fingerprint").collect()}
        new = {c.fingerprint: c for c in claims if c.fingerprint not in there}
        if new:
            self._append(CLAIM, self.spark.createDataFrame([(k, c.text, c.notes) for k, c in new.items()], "fingerprint string, content string, notes string"))
        return [c.fingerprint for c in claims]

    def claims(self) -> DataFrame:
        """fingerprint, name, trial_budget, content, notes of each claim."""
        own = self.rows().where(F.col("kind") == CLAIM)
        told = F.from_json("content", "name string, trial_budget long")
        return own.select("fingerprint", told["name"].alias("name"), told["trial_budget"].alias("trial_budget"), "content", "notes")

    def unregistered(self, trials: DataFrame) -> DataFrame:
        """The trials (fingerprint, ...) for which no claim is filed."""
        return trials.join(self.claims().select("fingerprint"), "fingerprint", "left_anti")

    def record_trials(self, trials: DataFrame) -> None:
        """trials: fingerprint, sharpe, label. All or none are filed."""
        stray = [r.fingerprint for r in self.unregistered(trials.select("fingerprint")).distinct().limit(5).collect()]
        if stray:
            raise PreregistrationError(f"trials for claims that are not registered: {stray}; write the claim down first")
        self._append(TRIAL, trials.select("fingerprint", F.to_json(F.struct("sharpe", "label")).alias("content"), F.lit("").alias("notes")))

    def record_verdict(self, fingerprint: str, verdict: Verdict, violations: Sequence[Violation]) -> None:
        content = json.dumps({"verdict": verdict.value, "violations": [asdict(v) for v in violations]})
        self._append(VERDICT, self.spark.createDataFrame([(fingerprint, content, "")], "fingerprint string, content string, notes string"))

    def trials(self) -> DataFrame:
        """fingerprint, sharpe, label of every trial ever filed: what a deflation has to count."""
        told = F.from_json("content", "sharpe double, label string")
        return self.rows().where(F.col("kind") == TRIAL).select("fingerprint", told["sharpe"].alias("sharpe"), told["label"].alias("label"))

    def standing(self) -> DataFrame:
        """Of each claim: fingerprint, name, trial_budget, trials, best_sharpe, verdict (the last one), over_budget."""
        used = self.trials().groupBy("fingerprint").agg(F.count("*").alias("trials"), F.max("sharpe").alias("best_sharpe"))
        judged = self.rows().where(F.col("kind") == VERDICT).groupBy("fingerprint").agg(F.max_by(F.get_json_object("content", "$.verdict"), "batch").alias("verdict"))
        both = self.claims().join(used, "fingerprint", "left").join(judged, "fingerprint", "left").withColumn("trials", F.coalesce("trials", F.lit(0).cast("long")))
        return both.select("fingerprint", "name", "trial_budget", "trials", "best_sharpe", "verdict", (F.col("trials") > F.col("trial_budget")).alias("over_budget"))

    def faults(self) -> DataFrame:
        """batch, fingerprint, fault: `unreadable` lines, rows whose content or place is not what was hashed
        (`changed`), claims filed under another hash (`misfiled`), batches that do not follow the one before
        (`unchained`, as after a removed row), and rows without a claim filed before them (`unregistered`)."""
        rows = self.rows()
        none = F.lit(None).cast("string").alias("fingerprint")
        found = rows.where("kind is null or batch is null").select("batch", none, F.lit("unreadable").alias("fault"))
        good = rows.where("kind is not null and batch is not null")
        changed = good.where(~F.col("mark").eqNullSafe(_mark())).select("batch", "fingerprint", F.lit("changed").alias("fault"))
        own = F.substring(F.sha2("content", 256), 1, 16)
        misfiled = good.where((F.col("kind") == CLAIM) & (own != F.col("fingerprint"))).select("batch", "fingerprint", F.lit("misfiled").alias("fault"))
        batches = good.groupBy("batch").agg(_digest(_mark()).alias("digest"), F.min("parent").alias("parent"), F.max("parent").alias("other"))
        before = batches.select((F.col("batch") + 1).alias("batch"), F.col("digest").alias("want"))
        chain = batches.join(before, "batch", "left").withColumn("want", F.when(F.col("batch") == 0, FIRST).otherwise(F.col("want")))
        unchained = chain.where(~F.col("parent").eqNullSafe(F.col("want")) | (F.col("parent") != F.col("other"))).select("batch", none, F.lit("unchained").alias("fault"))
        filed = good.where(F.col("kind") == CLAIM).groupBy("fingerprint").agg(F.min("batch").alias("since"))
        stray = good.where(F.col("kind") != CLAIM).join(filed, "fingerprint", "left").where("since is null or since > batch").select("batch", "fingerprint", F.lit("unregistered").alias("fault"))
        return found.unionByName(changed).unionByName(misfiled).unionByName(unchained).unionByName(stray)

    def checked(self) -> Journal:
        """The journal, or PreregistrationError with the first of its faults."""
        some = self.faults().limit(3).collect()
        if some:
            raise PreregistrationError(f"{self.folder} is not as it was written: {[(r.batch, r.fingerprint, r.fault) for r in some]}")
        return self
