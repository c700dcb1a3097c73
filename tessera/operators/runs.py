"""The runs of a project, what each reads, and what comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.grid import kind_of


def scan_runs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, refusals) of run files (project, folder, json), a JSON object each.

    runs: (project, folder, delivery_id, label, issue, read_from, unit_tag, tag_no). A run names its delivery; an issue, `set` or `addendum`; a list of
    distinct deliveries that it reads from, its own among them; a tag, a small i and a number from 1; and a count of 0 of the rows that
    the record held under `scopeItem:<tag>-` before it. No two runs of a project have one tag or one delivery: J16, of which both are
    refused. refusals: (project, folder, rule), the first rule broken. A label that is absent is the delivery's id. Null projects or folders are passed over.
    """
    v = F.col("v")
    text = lambda p: F.when(kind_of(v, p) == "STRING", F.nullif(F.try_variant_get(v, p, "string"), F.lit("")))
    listed = F.when(F.startswith(kind_of(v, "$.readFrom"), F.lit("ARRAY")), F.try_variant_get(v, "$.readFrom", "array<variant>"))
    r = files.where("project is not null and folder is not null").select("project", "folder", F.try_parse_json("json").alias("v"))
    r = r.select(
        "project", "folder", F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)).alias("is_object"), text("$.deliveryId").alias("delivery_id"), text("$.label").alias("label"), text("$.issue").alias("issue"),
        listed.alias("listed"), text("$.unitTag").alias("unit_tag"), text("$.unitTagCheck.subjectPrefix").alias("prefix"), F.when(kind_of(v, "$.unitTagCheck.count") == "BIGINT", F.try_variant_get(v, "$.unitTagCheck.count", "bigint")).alias("count"),
    )
    texts = F.transform("listed", lambda x: F.when(F.schema_of_variant(x) == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))))
    r = r.withColumn("read_from", texts)
    fine = F.col("read_from").isNotNull() & ~F.exists("read_from", lambda x: x.isNull()) & (F.size(F.array_distinct("read_from")) == F.size("read_from")) & F.array_contains("read_from", F.col("delivery_id"))
    rule = (
        F.when(~F.col("is_object"), "no run file").when(F.col("delivery_id").isNull(), "names no delivery").when(~F.coalesce(F.col("issue").isin("set", "addendum"), F.lit(False)), "issue is neither set nor addendum")
        .when(~F.coalesce(fine, F.lit(False)), "readFrom is no list of distinct deliveries with its own").when(~F.coalesce(F.col("unit_tag").rlike("^i[1-9][0-9]*$"), F.lit(False)), "no unit tag")
        .when(~F.coalesce((F.col("prefix") == F.concat(F.lit("scopeItem:"), "unit_tag", F.lit("-"))) & F.col("count").isNotNull(), F.lit(False)), "no count under its tag").when(F.col("count") != 0, "its tag is taken on the record")
    )
    r = r.withColumn("rule", rule)
    # another run's tag and delivery count even where its file breaks another rule
    same = lambda c: F.count(c).over(Window.partitionBy("project", c))
    r = r.withColumn("tags", same("unit_tag")).withColumn("runs", same("delivery_id"))
    r = r.withColumn("rule", F.coalesce("rule", F.when(F.col("tags") > 1, "its tag is another run's").when(F.col("runs") > 1, "its delivery is another run's")))
    good = r.where("rule is null").select("project", "folder", "delivery_id", F.coalesce("label", "delivery_id").alias("label"), "issue", "read_from", "unit_tag", F.substring("unit_tag", F.lit(2), F.length("unit_tag")).cast("long").alias("tag_no"))
    return good, r.where("rule is not null").select("project", "folder", "rule")


def next_actions(deliveries: DataFrame, runs: DataFrame) -> DataFrame:
    """(project, action, delivery_id, folder, tag_no): what comes next on every project of `deliveries` or `runs`.

    `deliveries`: (project, ord, delivery_id, issue, set_id, still_reading); `runs`: (project, folder, delivery_id, tag_no, closed). In this order: two runs or more
    that are not closed are a `refusal`, one is to `resume`; the first delivery that is still being read is to `wait` for; the last set is to
    `start` if no run reads it, else the first addendum of it that none reads; else, and without a set, there is `none`. tag_no: the
    one that a start takes, past every run's. A null `closed` or `still_reading` is false. One row a project: aggregates alone.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    r = runs.where("project is not null").groupBy("project").agg(F.count_if(~flag("closed")).alias("open"), F.min(F.when(~flag("closed"), F.struct("folder", "delivery_id"))).alias("flight"), F.max("tag_no").alias("top"))
    read = runs.select("project", "delivery_id", F.lit(True).alias("covered")).distinct()
    d = deliveries.where("project is not null").join(read, ["project", "delivery_id"], "left")
    row = F.struct("ord", "delivery_id", F.coalesce("covered", F.lit(False)).alias("covered"))
    sets = d.groupBy("project").agg(F.min(F.when(flag("still_reading"), F.struct("ord", "delivery_id")))["delivery_id"].alias("reading"), F.max(F.when(F.col("issue") == "set", row)).alias("last"))
    later = d.join(sets.select("project", F.col("last.delivery_id").alias("set_id")), ["project", "set_id"]).where("issue = 'addendum' and covered is null").groupBy("project").agg(F.min(F.struct("ord", "delivery_id"))["delivery_id"].alias("addendum"))
    j = sets.join(r, "project", "full_outer").join(later, "project", "left")
    starts = F.when(F.col("last").isNotNull(), F.when(~F.col("last.covered"), F.col("last.delivery_id")).otherwise(F.col("addendum")))
    action = F.when(F.col("open") > 1, "refusal").when(F.col("open") == 1, "resume").when(F.col("reading").isNotNull(), "wait").when(starts.isNotNull(), "start").otherwise("none")
    j = j.withColumn("action", action)
    a = F.col("action")
    what = F.when(a == "resume", F.col("flight.delivery_id")).when(a == "wait", F.col("reading")).when(a == "start", starts)
    return j.select("project", "action", what.alias("delivery_id"), F.when(a == "resume", F.col("flight.folder")).alias("folder"), F.when(a == "start", F.coalesce("top", F.lit(0)) + 1).alias("tag_no"))
