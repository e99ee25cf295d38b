"""Fund-name resolution by equi-joins on word prefixes.

A target resolves, inside its house, to
  1. the master fund of exactly its name, else
  2. the longest master name that is a whole-word prefix of it, else
  3. the only master name that it is a whole-word prefix of, else nothing.
Targets of fewer than two words resolve to nothing. Master names and targets are
expanded to their word prefixes, so the work grows with the words in the names,
not with pairs of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.names import master_identity


def _prefixes(name: str) -> Column:
    words = F.split(F.col(name), " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))


def master_identities(master: DataFrame) -> DataFrame:
    """(amc, scheme_code, identity) of every named fund."""
    return (master.select("amc", "scheme_code", master_identity(F.col("name")).alias("identity"))
                  .filter(F.col("identity") != ""))


def resolve_names(targets: DataFrame, master: DataFrame) -> DataFrame:
    """``targets`` (amc, target) -> one row per distinct target with the matched
    ``identity`` and the ``stage`` that matched it, both null when refused."""
    names = master_identities(master).select("amc", "identity").distinct()
    lookup = (names.select("amc", "identity", F.explode(_prefixes("identity")).alias("key"))
                   .withColumn("whole", F.col("key") == F.col("identity"))
                   .groupBy("amc", "key")
                   .agg(F.max("whole").alias("is_name"),
                        F.sum(F.when(~F.col("whole"), 1).otherwise(0)).alias("longer_names"),
                        F.min(F.when(~F.col("whole"), F.col("identity"))).alias("longer")))
    probes = (targets.select("amc", "target").distinct()
              .select("amc", "target", F.explode(_prefixes("target")).alias("key"))
              .withColumn("whole_target", F.col("key") == F.col("target"))
              .withColumn("specific", F.size(F.split("target", " ")) >= K.MIN_NAME_TOKENS))

    def candidate(rank: int, size: Column, identity: str) -> Column:
        return F.struct(F.lit(rank).alias("rank"), size.alias("size"), F.col(identity).alias("identity"))

    hit = (F.when(F.col("is_name") & F.col("whole_target"), candidate(3, F.lit(0), "key"))
            .when(F.col("is_name"), candidate(2, F.length("key"), "key"))
            .when(F.col("whole_target") & (F.col("longer_names") == 1), candidate(1, F.lit(0), "longer")))
    best = (probes.join(lookup, ["amc", "key"], "left")
                  .groupBy("amc", "target").agg(F.max(F.when(F.col("specific"), hit)).alias("hit")))
    stage = F.element_at(F.array(F.lit("reverse"), F.lit("prefix"), F.lit("exact")), F.col("hit.rank"))
    return best.select("amc", "target", F.col("hit.identity").alias("identity"),
                       F.when(F.col("hit").isNotNull(), stage).alias("stage"))


def resolve_codes(targets: DataFrame, master: DataFrame) -> DataFrame:
    """(amc, target, scheme_code, stage): a resolved target fans out to every plan
    and option code of its fund; refused targets do not appear."""
    matched = resolve_names(targets, master).filter(F.col("identity").isNotNull())
    return matched.join(master_identities(master), ["amc", "identity"]).select("amc", "target", "scheme_code", "stage")
