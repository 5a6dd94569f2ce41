"""Stages of candidates: results applied in their order, with every refusal as a row; the same rules for batch and stream.

Candidates have candidate_id, stage1_result, stage2_result and stage3_result (``not_run`` before), final_decision and is_anchor, and
may have the two scores.  Events have candidate_id, pos (their order, unique within a candidate, from 0), stage (2 or 3) and score.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.operators.sequences import running
from trialframe.operators.workflow import ceiling_band, score_band, slug

#: Outcomes of an event.
OUTCOMES = ("applied", "unknown_candidate", "unknown_stage", "no_score", "stage1_not_passed", "not_included", "already_run")
#: What a stage can hold: nothing yet, or the result of an event.
RESULTS = ("not_run", "EXCLUDE", "INCLUDE", "DEFER", "ceiling_risk", "preferred")
BEFORE = "stage1_result", "stage2_result", "stage3_result", "final_decision", "is_anchor"


def _refused(known: Column, stage1: Column) -> Column:
    """Why an event is refused by its row and its candidate's first stage alone, else null."""
    return (
        F.when(known.isNull(), "unknown_candidate")
        .when(~F.coalesce(F.col("stage").isin(2, 3), F.lit(False)), "unknown_stage")
        .when(F.col("score").isNull(), "no_score")
        .when((F.col("stage") == 2) & ~stage1.eqNullSafe(F.lit("PASS")), "stage1_not_passed")
    )


def _place(said: Column, names: tuple[str, ...]) -> Column:
    """Where a name stands in ``names``, -1 if it doesn't."""
    return (F.array_position(F.array(*map(F.lit, names)), said) - 1).cast("int")


def stage_log(candidates: DataFrame, events: DataFrame, overwrite: bool = False) -> DataFrame:
    """Every event with its outcome and, if it was applied, the result it set: candidate_id, pos, stage, score, outcome, result.

    Stage 2 needs a passed stage 1; stage 3 needs an anchor or a candidate that is included at that place of the order.
    Candidates are merged with their events: by the size of a packed file millions of them would be broadcast.
    A result stays unless ``overwrite``.  What a candidate's state is at an event is a running maximum by blocks of
    places, so a candidate with very many events is dealt to many tasks.
    """
    state = candidates.select("candidate_id", *(F.col(c).alias(f"__{c}") for c in BEFORE), F.lit(True).alias("__known")).hint("merge")
    own = events.select("candidate_id", "pos", "stage", "score").join(state, "candidate_id", "left")
    run2, run3 = F.col("__stage2_result") != "not_run", F.col("__stage3_result") != "not_run"
    own = own.withColumn("__why", _refused(F.col("__known"), F.col("__stage1_result")))
    second = (F.col("stage") == 2) & F.col("__why").isNull()
    if not overwrite:
        first = own.where(second & ~run2).groupBy("candidate_id").agg(F.min("pos").alias("__first"))
        own = own.join(first, "candidate_id", "left")
        second = second & F.col("pos").eqNullSafe(F.col("__first"))
    own = own.withColumn("__set", F.when(second, F.struct(F.col("pos").alias("p"), score_band(F.col("score")).alias("d"))))
    own = running(own, "__set", "__last", "max", seq="candidate_id")
    held = F.coalesce(F.col("__last.d"), F.col("__stage2_result"))
    third = (F.col("stage") == 3) & F.col("__why").isNull() & (F.coalesce("__is_anchor", F.lit(False)) | (held == "INCLUDE"))
    own = own.withColumn("__third", third)
    if not overwrite:
        first = own.where(third & ~run3).groupBy("candidate_id").agg(F.min("pos").alias("__first3"))
        own = own.join(first, "candidate_id", "left")
        third = F.col("__third") & F.col("pos").eqNullSafe(F.col("__first3"))
    else:
        third = F.col("__third")
    applied = F.col("__set").isNotNull() | third
    outcome = F.when(applied, "applied").when(F.col("__why").isNotNull(), F.col("__why")).when((F.col("stage") == 3) & ~F.col("__third"), "not_included").otherwise("already_run")
    result = F.when(F.col("__set").isNotNull(), F.col("__set.d")).when(third, ceiling_band(F.col("score")))
    return own.select("candidate_id", "pos", "stage", "score", outcome.alias("outcome"), result.alias("result"))


def apply_log(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """The candidates after the applied events of a log: results, scores and the final decision.

    The last result of a stage counts.  An anchor stays included; else stage 2 decides, but for ``DEFER``, which leaves the decision as it was.
    """
    at = lambda stage, value: F.max_by(F.when(F.col("stage") == stage, F.col(value)), F.when(F.col("stage") == stage, F.col("pos")))
    decided = F.when((F.col("stage") == 2) & (F.col("result") != "DEFER"), F.col("pos"))
    last = log.where("outcome = 'applied'").groupBy("candidate_id").agg(
        at(2, "result").alias("__r2"), at(2, "score").alias("__s2"), at(3, "result").alias("__r3"), at(3, "score").alias("__s3"), F.max_by("result", decided).alias("__d"), F.count_if(F.col("stage") == 2).alias("__n2"))
    out = candidates.join(last, "candidate_id", "left")
    final = F.when(F.col("is_anchor") & (F.col("__n2") > 0), "INCLUDE").otherwise(F.coalesce("__d", "final_decision"))
    score = lambda c, new: F.coalesce(new, F.col(c)) if c in candidates.columns else F.col(new)
    changed = {"stage2_result": F.coalesce("__r2", "stage2_result"), "stage3_result": F.coalesce("__r3", "stage3_result"), "stage2_score": score("stage2_score", "__s2"), "stage3_score": score("stage3_score", "__s3")}
    return out.withColumn("final_decision", final).withColumns(changed).drop("__r2", "__s2", "__r3", "__s3", "__d", "__n2")


def exclusion_reason(result: Column, score: Column, given: Column | None = None) -> Column:
    """What is said of an excluded candidate, if nothing was given."""
    said = F.format_string("T2 C1 score=%.1f (>= 3.0; too easy for discriminative T2)", score)
    given = F.lit(None).cast("string") if given is None else given
    return F.when(result == "EXCLUDE", F.coalesce(given, said)).otherwise(given)


def stage_stream(candidates: DataFrame, events: DataFrame, states: int = 4096) -> DataFrame:
    """``stage_log`` of a stream (without overwriting), the applied results being kept as state.

    Events of a candidate must arrive in their order, those of one micro-batch in any.  What is refused whatever came before
    goes past the state.  A group costs Python some thousand times what a row does, so candidates share ``states``
    states by their hash: a number that must stay for as long as a checkpoint is used, best some hundred candidates to
    each.  Python gets outcomes and results as their places in ``OUTCOMES`` and ``RESULTS``.
    """
    kind = dict(events.dtypes)["candidate_id"]
    not_run, include = RESULTS.index("not_run"), RESULTS.index("INCLUDE")
    applied, not_included, already_run = map(OUTCOMES.index, ("applied", "not_included", "already_run"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        twos, threes = state.get if state.exists else ({}, {})
        own = pd.concat(list(batches), ignore_index=True).sort_values("pos", kind="stable", ignore_index=True)
        outcome, result = [], []
        for one, stage, sets, second, third, anchor in zip(*(own[c].tolist() for c in ("one", "stage", "sets", "second", "third", "is_anchor")), strict=True):
            two = twos.get(one, second)
            if stage == 3 and not (anchor or two == include):
                outcome.append(not_included)
            elif (two if stage == 2 else threes.get(one, third)) != not_run:
                outcome.append(already_run)
            else:
                outcome.append(applied)
                (twos if stage == 2 else threes)[one] = sets
            result.append(sets if outcome[-1] == applied else not_run)
        state.update((twos, threes))
        yield own[["candidate_id", "pos", "stage", "score"]].assign(outcome=outcome, result=result)

    held = lambda c: _place(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("not_run")), RESULTS)
    known = candidates.select("candidate_id", "stage1_result", held("stage2_result").alias("second"), held("stage3_result").alias("third"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), F.lit(True).alias("known")).hint("merge")
    score = F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double"))
    own = events.select("candidate_id", F.col("pos").cast("long").alias("pos"), F.col("stage").cast("long").alias("stage"), score.alias("score")).join(known, "candidate_id", "left")
    own = own.withColumn("outcome", _refused(F.col("known"), F.col("stage1_result")))
    names = ["candidate_id", "pos", "stage", "score", "outcome", "result"]
    past = own.where(F.col("outcome").isNotNull()).withColumn("result", F.lit(None).cast("string")).select(names)
    sets = F.when(F.col("stage") == 2, score_band(F.col("score"))).otherwise(ceiling_band(F.col("score")))
    able = own.where(F.col("outcome").isNull()).select(*names[:4], F.col("candidate_id").cast("string").alias("one"), _place(sets, RESULTS).alias("sets"), "second", "third", "is_anchor", F.pmod(F.xxhash64("candidate_id"), F.lit(states)).alias("at"))
    out = able.groupBy("at").applyInPandasWithState(update, f"candidate_id {kind}, pos long, stage long, score double, outcome int, result int", "two map<string, int>, three map<string, int>", "append", "NoTimeout")
    said = lambda c, among: F.array(*map(F.lit, among))[F.col(c)]
    return past.union(out.select(*names[:4], said("outcome", OUTCOMES).alias("outcome"), F.when(F.col("result") != not_run, said("result", RESULTS)).alias("result")))


def score_file(candidate: Column, task: str, condition: str, model: Column) -> Column:
    """The file name of a candidate's score."""
    return F.concat(slug(candidate, F.lit(task), F.lit(condition), model), F.lit(".json"))


def ingest(candidates: DataFrame, scores: DataFrame, stage: int, model: Column, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Takes a run's scores (file, status, score) in: the candidates afterwards, and an outcome for each eligible one.

    Eligible are candidates that passed stage 1 (stage 2), or are included or anchors (stage 3).  Outcomes: ``skip`` (has a result and nothing is overwritten), ``miss``
    (the run has no file of that name), ``scorer_failed`` (its status isn't ok; strict callers hold this against ``workflow.demand_none``),
    ``hit``.  Taking the same run in again changes nothing and skips every hit.
    """
    task, condition = {2: ("T2", "C1"), 3: ("T3", "C2")}[stage]
    able = F.col("stage1_result") == "PASS" if stage == 2 else (F.col("stage2_result") == "INCLUDE") | F.col("is_anchor")
    asked = candidates.where(able).select("candidate_id", score_file(F.col("candidate_id").cast("string"), task, condition, model).alias("file"), (F.col(f"stage{stage}_result") != "not_run").alias("__ran"))
    files = scores.select("file", "status", "score", F.lit(True).alias("__there"))
    met = asked.join(files, "file", "left")
    skip = F.lit(False) if overwrite else F.col("__ran")
    outcome = F.when(skip, "skip").when(F.col("__there").isNull(), "miss").when(~F.col("status").eqNullSafe(F.lit("ok")), "scorer_failed").otherwise("hit")
    log = met.select("candidate_id", "file", F.lit(stage).alias("stage"), outcome.alias("outcome"), F.when(outcome == "hit", F.col("score")).alias("score"))
    events = log.where("outcome = 'hit'").select("candidate_id", F.lit(0).cast("long").alias("pos"), "stage", "score")
    return apply_log(candidates, stage_log(candidates, events, overwrite)), log


def seed(table: DataFrame, rows: DataFrame, key: str = "candidate_id") -> tuple[DataFrame, DataFrame]:
    """Adds rows whose key the table lacks; the table, and the keys that were added."""
    new = rows.join(table.select(key), key, "left_anti")
    return table.unionByName(new.select(table.columns)), new.select(key)
