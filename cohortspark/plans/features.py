"""Feature tables per model age, and features in time windows around anchors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.nulls import mean_strict
from cohortspark.functions.numeric import bucketize
from cohortspark.operators.keys import natural_join
from cohortspark.operators.ordered import cut_points, running, sliced
from cohortspark.sources.stored import settle

LAB_WINDOW_YEARS = 5.0


def lab_name(track: str) -> str:
    return f"lab_{track}"


def disease_name(cohort: str) -> str:
    return f"dx_{cohort}"


def model_age_values(
    labs: DataFrame, onsets: DataFrame, ages: Sequence[int], lab_features: Mapping[int, str], diseases: Sequence[str]
) -> DataFrame:
    """Long (id, model_age, feature, value): lab quantiles of the last five years, disease flags.

    Each measurement is sent to the model ages whose window holds it (at most two when the
    ages are five years apart), so all ages are built in one pass.
    """
    model_ages = F.array(*[F.lit(int(a)) for a in ages])
    tracks = F.create_map(*[x for f, t in lab_features.items() for x in (F.lit(int(f)), F.lit(lab_name(t)))])
    age = F.col("age")
    lab = labs.filter(F.col("q").isNotNull() & F.col("field").isin([int(f) for f in lab_features])).select(
        "id",
        F.explode(F.filter(model_ages, lambda a: (age < a) & (age > a - LAB_WINDOW_YEARS))).alias("model_age"),
        tracks[F.col("field")].alias("feature"),
        F.col("q").alias("value"),
    )
    dx = onsets.filter(F.col("cohort").isin(list(diseases))).select(
        "id",
        F.explode(F.filter(model_ages, lambda a: age <= a)).alias("model_age"),
        F.concat(F.lit(disease_name("")), "cohort").alias("feature"),
        F.lit(1.0).alias("value"),
    )
    return lab.unionByName(dx)


def feature_matrix(
    labs: DataFrame, onsets: DataFrame, demog: DataFrame, ages: Sequence[int], lab_features: Mapping[int, str],
    diseases: Sequence[str], required: str | None = None,
) -> DataFrame:
    """One row per patient and model age: labs (null when absent), diseases 0/1, age, sex, male."""
    labs_out = [lab_name(t) for t in lab_features.values()]
    dx_out = [disease_name(d) for d in diseases]
    long = model_age_values(labs, onsets, ages, lab_features, diseases)
    wide = long.groupBy("id", "model_age").pivot("feature", [*labs_out, *dx_out]).agg(F.avg("value"))
    if required is not None:
        wide = wide.filter(F.col(lab_name(required)).isNotNull())
    wide = wide.fillna(0.0, subset=dx_out)
    return wide.join(demog.select("id", "sex"), "id", "left").select(
        "id", F.col("model_age").alias("age"), "sex", (F.col("sex") == 1).cast("int").alias("male"), *labs_out, *dx_out)


def bucket_label(start: float) -> str:
    return f"{start:g}".replace("-", "minus")


def feature_buckets(
    labs: DataFrame, onsets: DataFrame, demog: DataFrame, age: int, tracks: Mapping[int, str],
    day_breaks: Sequence[float], diseases: Mapping[str, tuple[int, int]],
) -> DataFrame:
    """Features of one model age, labs split by how long before that age they were taken.

    ``diseases`` maps a cohort to the day window in its feature name. Only patients with a
    lab in some bucket are kept; a lab without a quantile makes its bucket's mean null.
    """
    names = {f: [f"{lab_name(t)}_{bucket_label(b)}" for b in day_breaks[:-1]] for f, t in tracks.items()}
    dt = (F.col("age") - F.lit(age)) * F.lit(365.0)
    bucket = bucketize(dt, day_breaks)
    label = F.create_map(*[x for f, ns in names.items() for x in (F.lit(int(f)), F.array(*[F.lit(n) for n in ns]))])
    lab = labs.filter((F.col("age") < age) & F.col("field").isin([int(f) for f in tracks])).select(
        "id", bucket.alias("_bucket"), "field", F.col("q").alias("value")
    ).filter(F.col("_bucket").isNotNull()).select(
        "id", F.element_at(label[F.col("field")], F.col("_bucket")).alias("feature"), "value", F.lit(1).alias("_lab"))
    dx_names = {c: f"{disease_name(c)}_{bucket_label(a)}_{bucket_label(b)}" for c, (a, b) in diseases.items()}
    dx_label = F.create_map(*[x for c, n in dx_names.items() for x in (F.lit(c), F.lit(n))])
    dx = onsets.filter((F.col("age") <= age) & F.col("cohort").isin(list(diseases))).select(
        "id", dx_label[F.col("cohort")].alias("feature"), F.lit(1.0).alias("value"), F.lit(0).alias("_lab"))
    lab_cols = [n for ns in names.values() for n in ns]
    dx_cols = list(dx_names.values())
    # the marker rides along as one more feature, so that one pivot serves both
    rows = lab.unionByName(dx).select("id", F.inline(F.array(
        F.struct(F.col("feature"), F.col("value")),
        F.struct(F.lit("_lab").alias("feature"), F.col("_lab").cast("double").alias("value")))))
    wide = rows.groupBy("id").pivot("feature", ["_lab", *lab_cols, *dx_cols]).agg(mean_strict(F.col("value")))
    wide = wide.filter(F.col("_lab") > 0).fillna(0.0, subset=dx_cols)
    sex = F.col("sex")
    return wide.join(demog.select("id", "sex"), "id", "left").select(
        "id", F.lit(float(age)).alias("age"), (sex == 2).cast("double").alias("female"),
        (sex == 1).cast("double").alias("male"), *lab_cols, *dx_cols)


def drop_sparse(long: DataFrame, keys: Sequence[str], max_missing: float) -> DataFrame:
    """Long feature rows of the features missing for less than a share of the key rows.

    Keys and features are counted from the long table itself; null values count as missing.
    """
    per_feature = long.filter(F.col("value").isNotNull()).groupBy("feature", *keys).agg(F.lit(1).alias("_x"))
    present = per_feature.groupBy("feature").agg(F.count("*").alias("_n"))
    total = long.select(*keys).distinct().count()
    kept = present.filter(1 - F.col("_n") / F.lit(max(total, 1)) < F.lit(max_missing)).select("feature")
    return long.join(kept, "feature", "left_semi")


# --- time windows around anchors ------------------------------------------------------

YEAR_HOURS = 24.0 * 365.0
MONTH_HOURS = 24.0 * 30.0


def patients_at_age(
    tracks: DataFrame, sexes: DataFrame, target: float, start: float, end: float, end_db: float,
    year: float = YEAR_HOURS, month: float = MONTH_HOURS,
) -> DataFrame:
    """Patients alive, registered, present and not gone when they reach an age.

    ``tracks`` holds (id, track, ts) with tracks dob, dod, register, lfg and absent; times
    and ``target`` are in the same unit. One anchor per patient, then one aggregate.
    """
    births = tracks.filter("track = 'dob'").groupBy("id").agg(F.min("ts").alias("dob"))
    anchors = births.withColumn("time", F.col("dob") + F.lit(float(target)))
    anchors = anchors.filter(F.col("time").between(float(start), float(end)))
    rows = tracks.filter("track <> 'dob'").join(anchors, "id")
    past = (F.col("ts") <= F.col("time")) & (F.col("ts") >= F.col("time") - 120 * year)
    ahead = (F.col("ts") >= F.col("time")) & (F.col("ts") <= F.col("time") + 120 * year)

    def seen(track: str, when):
        return F.max(F.when((F.col("track") == track) & when, 1).otherwise(0))

    def next_of(track: str):
        return (F.min(F.when((F.col("track") == track) & ahead, F.col("ts"))) - F.col("time")) / F.lit(year)

    recent = (F.col("ts") <= F.col("time")) & (F.col("ts") >= F.col("time") - month)
    state = rows.groupBy("id", "dob", "time").agg(
        seen("dod", past).alias("dead"), seen("register", past).alias("registered"),
        seen("lfg", past).alias("gone"), seen("absent", recent).alias("absent"),
        next_of("dod").alias("survival"), next_of("lfg").alias("left_for_good"),
    )
    state = state.filter("dead = 0 AND registered = 1 AND gone = 0 AND absent = 0")
    return state.join(sexes.select("id", "sex"), "id", "left").select(
        "id", "time", ((F.col("time") - F.col("dob")) / F.lit(year)).alias("age"), "sex", "survival", "left_for_good",
        F.coalesce("left_for_good", (F.lit(float(end_db)) - F.col("time")) / F.lit(year)).alias("time_in_system"))


BAND = 10  # decades that share an exact sum


def window_values(
    anchors: DataFrame, tracks: DataFrame, windows: Mapping[str, tuple[float, float]], slices: int | None = None
) -> DataFrame:
    """Per (id, t) and track: size, mean and earliest of the values in [t+lo, t+hi].

    Also dt1 (first time minus t) and dt2 (t minus first time). ``size`` counts events, the
    mean is over known values (null without any; what is not finite is unknown). A repeated
    anchor is one anchor. No anchor is joined with its events: each puts two marks on the
    patient's time line, one before its window and one after it; running totals at the marks
    differ by what the window holds, and the next event after the first mark is the earliest
    one. Work grows with events plus anchors even for a patient with most of both. Totals are
    decimals, so that they subtract without loss, kept apart for each ten decades of
    magnitude, so that any double fits.
    """
    wanted = list(windows)
    known = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    scale = lambda band: F.pow(F.lit(10.0), F.lit(float(BAND)) * band)
    band = F.coalesce(F.when(known != 0, F.greatest(F.floor(F.log10(F.abs(known)) / BAND), F.lit(-30))), F.lit(0)).cast("int")
    events = tracks.filter(F.col("track").isin(wanted)).select(
        "id", "track", F.col("ts").cast("double").alias("ts"), F.col("value").cast("double").alias("value")).withColumn("band", band).select(
        "id", "track", "ts", F.lit(1).alias("phase"), F.lit(None).cast("double").alias("t"), "band",
        (known / scale(F.col("band"))).cast("decimal(27,16)").alias("v"), F.lit(1).alias("one"), known.isNotNull().cast("int").alias("sure"),
        F.struct("ts", "value").alias("ev"))
    per_track = [
        F.struct(F.lit(k).alias("track"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
        for k, (lo, hi) in windows.items()
    ]
    marks = anchors.select("id", F.col("t").cast("double").alias("t")).distinct().select("id", "t", F.inline(F.array(*per_track)))
    marks = marks.select(
        "id", "track", "t",
        F.inline(F.array(
            F.struct((F.col("t") + F.col("lo")).alias("ts"), F.lit(0).alias("phase")),
            F.struct((F.col("t") + F.col("hi")).alias("ts"), F.lit(2).alias("phase")))),
    )
    marks = marks.withColumns({
        "v": F.lit(None).cast("decimal(27,16)"), "one": F.lit(0), "sure": F.lit(0),
        "ev": F.lit(None).cast("struct<ts:double,value:double>")})
    bands = events.select("id", "track", "band").distinct()
    banded = natural_join(marks, bands, "left", on=["id", "track"]).withColumn("band", F.coalesce("band", F.lit(0)))
    keys = ["id", "track", "band"]
    cuts = cut_points(tracks.filter(F.col("track").isin(wanted)), "ts", slices)  # of both directions
    line, slice_col = sliced(events.unionByName(banded.select(events.columns)), "ts", cuts)
    sums = running(line, keys, [F.col("ts"), F.col("phase")],
                   {"total": ("sum", "v"), "size": ("sum", "one"), "sure_size": ("sum", "sure")}, slice_col)
    # the same line backwards, all magnitudes together, gives the next event
    line = events.unionByName(marks.withColumn("band", F.lit(0)).select(events.columns))
    back, slice_col = sliced(line.withColumns({"_ts": -F.col("ts"), "_phase": -F.col("phase")}), "ts", cuts)
    if slice_col:
        back = back.withColumn(slice_col, -F.col(slice_col))
    upcoming = running(
        back.withColumn("_tie", F.coalesce(-F.col("ev.value"), F.lit(0.0))), ["id", "track"],
        [F.col("_ts"), F.col("_phase"), F.col("_tie")], {"next": ("last", "ev")}, slice_col,
    )
    low = F.col("phase") == 0
    held = lambda c: F.sum(F.when(low, -F.col(c)).otherwise(F.col(c))).alias(c)
    counts = sums.filter("phase <> 1").groupBy(*keys, "t").agg(held("size"), held("sure_size"), held("total"))
    counts = counts.groupBy("id", "track", "t").agg(
        F.sum("size").alias("size"), F.sum("sure_size").alias("sure"), F.sum(F.col("total").cast("double") * scale(F.col("band"))).alias("total"))
    firsts = upcoming.filter(low).select("id", "track", "t", "next")
    joined = counts.join(firsts, ["id", "track", "t"])
    some = F.col("size") > 0
    return joined.select(
        "id", "t", "track", "size",
        F.when(F.col("sure") > 0, F.col("total") / F.col("sure")).alias("avg"),
        F.when(some, F.col("next.value")).alias("earliest"),
        F.when(some, F.col("next.ts") - F.col("t")).alias("dt1"),
        F.when(some, F.col("t") - F.col("next.ts")).alias("dt2"),
    )


def window_features(
    anchors: DataFrame, tracks: DataFrame, labs: Sequence[str], labs_window: tuple[float, float],
    diseases: Sequence[str], diseases_window: tuple[float, float], max_missing: float = 1.0, slices: int | None = None,
    people: DataFrame | None = None,
) -> DataFrame:
    """One row per (id, t): lab means, disease 0/1, without features missing too often.

    people: id, t, age, sex (1 or 2); with it every such anchor has a row, with its age and
    ``sex`` less one in front of the features.
    """
    windows = {**{k: labs_window for k in labs}, **{k: diseases_window for k in diseases}}
    values = window_values(anchors, tracks, windows, slices)
    long = values.select(
        "id", "t", F.col("track").alias("feature"),
        F.when(F.col("track").isin(list(diseases)), (F.col("size") > 0).cast("double")).otherwise(F.col("avg")).alias("value"))
    long = settle(long, "windows")  # read for the shares and again for the table
    share = long.groupBy("feature").agg((F.count("value") / F.count(F.lit(1))).alias("present")).collect()
    present = {r["feature"]: r["present"] for r in share}  # one number per feature
    kept = [f for f in windows if 1 - present.get(f, 0.0) < max_missing]
    wide = long.groupBy("id", "t").pivot("feature", kept).agg(F.max("value"))
    if people is None:
        return wide
    return natural_join(people.select("id", "t", "age", (F.col("sex") - 1).alias("sex")), wide, "left", on=["id", "t"])
