"""Regeneration of rollout groups, replayed over rounds of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("query", "polluted", "fell_back")


def replay(samples: DataFrame, candidates: DataFrame, group: str, idx: str, source: str, least_unique: int = 4, most_rounds: int = 2) -> DataFrame:
    """Which samples of each group stand after its rounds: group, idx, query, polluted, fell_back, round (0: the first
    sample's, else that of the candidate which took its place).

    samples: group, idx, source, query, polluted, fell_back; candidates: group, idx, round (from 1), query, polluted,
    fell_back. A round looks for samples that repeat an earlier query, are polluted or copy the source; in order of idx, each
    one's candidate takes its place if its query is new in the group as it stands then, or if it is free of a fault
    (pollution, copy, fallback) that the sample has. Rounds end when min(group size, least_unique) different queries stand,
    when there is nothing to replace, when a round changes nothing, or after most_rounds. A sample without a candidate in a
    round stays; null queries count as empty; of candidates that repeat a (group, idx, round) the least counts.

    Each decision depends on the one before, so a group is folded as a whole: it is one prompt's samples, bounded by the
    group size of a rollout times the rounds. Groups are dealt by key."""
    kept = [F.coalesce("query", F.lit("")).alias("query"), *[F.coalesce(c, F.lit(False)).alias(c) for c in FIELDS[1:]]]
    first = samples.select(F.col(group).alias("grp"), F.col(idx).cast("long").alias("idx"), F.lit(0).alias("round"), F.coalesce(source, F.lit("")).alias("source"), *kept)
    later = candidates.where((F.col("round") >= 1) & (F.col("round") <= most_rounds)).select(F.col(group).alias("grp"), F.col(idx).cast("long").alias("idx"), F.col("round").cast("int").alias("round"), F.lit(None).cast("string").alias("source"), *kept)
    key = samples.schema[group].dataType.simpleString()

    def fold(frame):
        import pandas as pd

        rows = sorted(zip(*[frame[c].tolist() for c in ("round", "idx", *FIELDS)], strict=True))
        state = {i: (q, p, f, 0) for r, i, q, p, f in rows if r == 0}
        offered: dict = {}
        for r, i, q, p, f in rows:
            offered.setdefault((r, i), (q, p, f, r))
        origin = next((s for s in frame["source"].tolist() if s is not None), "").strip().lower()
        copies = lambda x: x[0].strip().lower() == origin
        target = min(len(state), least_unique)
        for r in range(1, most_rounds + 1):
            if target <= 1 or len({x[0] for x in state.values()}) >= target:
                break
            seen, wanted = set(), []
            for i, x in state.items():  # ascending idx
                if x[0] in seen or x[1] or copies(x):
                    wanted.append(i)
                seen.add(x[0])
            changed = False
            for i in wanted:
                new, old = offered.get((r, i)), state[i]
                if new is None:
                    continue
                fresh = new[0] != "" and all(x[0] != new[0] for j, x in state.items() if j != i)
                if fresh or (old[1] and not new[1]) or (copies(old) and not copies(new)) or (old[2] and not new[2]):
                    state[i], changed = new, True
            if not changed:
                break
        out = [(frame["grp"].iloc[0], i, *x) for i, x in state.items()]
        return pd.DataFrame(out, columns=["grp", "idx", *FIELDS, "round"])

    done = first.unionByName(later).groupBy("grp").applyInPandas(fold, f"grp {key}, idx long, query string, polluted boolean, fell_back boolean, round int")
    return done.withColumnRenamed("grp", group).withColumnRenamed("idx", idx)
