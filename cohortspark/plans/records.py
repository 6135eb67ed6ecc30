"""From the raw table to demographics, visits, diagnoses, cancers and disease onsets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.dates import age_on, birth_date, date_at, parse_day_month_year
from cohortspark.functions.nulls import blank_to_null, ifelse
from cohortspark.sources.wide import first_occurrences, long_fields, paired_fields, raw_columns, row_min

# --- fixed values: field numbers of the raw table -------------------------------------
SEX, BIRTH_MONTH, BIRTH_YEAR = 31, 52, 34
DEATH_DATE, ETHNICITY, VISIT_DATE = 40000, 21000, 53
ICD10_CODE, ICD10_DATE, ICD9_CODE, ICD9_DATE = 41270, 41280, 41271, 41281
SELF_CODE, SELF_AGE = 20002, 20009
CANCER_ICD10, CANCER_ICD9, CANCER_AGE = 40006, 40013, 40008
SELF_CANCER, SELF_CANCER_AGE = 20001, 20007
MOTHER_DEATH, MOTHER_AGE, FATHER_DEATH, FATHER_AGE = 3526, 1845, 1807, 2946
SOCIO = 738


def demographics(raw: DataFrame, portal_deaths: DataFrame | None = None) -> DataFrame:
    """id, sex (1 male, 2 female), dob, race_i, date_i, age_i, dod.

    Rows without sex or birth month or year are dropped. Death is the earlier of the
    recorded dates, or else the date in ``portal_deaths`` (eid, date_of_death as text).
    """
    def one(field: int, instance: int = 0):
        return next((F.col(c.column) for c in raw_columns(raw, [field]) if c.instance == instance), F.lit(None))

    deaths = [F.col(c.column).cast("date") for c in raw_columns(raw, [DEATH_DATE])]
    dod = F.least(*deaths) if len(deaths) > 1 else (deaths[0] if deaths else F.lit(None).cast("date"))
    races = [(c.instance, F.col(c.column)) for c in raw_columns(raw, [ETHNICITY])]
    visits = [(c.instance, F.col(c.column).cast("date")) for c in raw_columns(raw, [VISIT_DATE])]
    dob = birth_date(one(BIRTH_YEAR), one(BIRTH_MONTH))
    table = raw.filter(one(SEX).isNotNull() & one(BIRTH_MONTH).isNotNull() & one(BIRTH_YEAR).isNotNull()).select(
        F.col("eid").alias("id"),
        (F.lit(2) - one(SEX)).cast("int").alias("sex"),
        dob.alias("dob"),
        *[v.alias(f"race_{i}") for i, v in races],
        *[v.alias(f"date_{i}") for i, v in visits],
        *[age_on(v, dob).alias(f"age_{i}") for i, v in visits],
        dod.alias("dod"),
    )
    if portal_deaths is None:
        return table
    portal = (
        portal_deaths.select(F.col("eid").alias("id"), parse_day_month_year(F.col("date_of_death")).alias("_portal"))
        .groupBy("id").agg(F.min("_portal").alias("_portal"))
    )
    joined = table.join(portal, "id", "left")
    return joined.withColumn("dod", F.coalesce("dod", "_portal")).drop("_portal")


def visits(demog: DataFrame) -> DataFrame:
    """id, sex, age, timepoint: one row per visit column, null ages kept."""
    ages = [c for c in demog.columns if c.startswith("age_")]
    long = demog.select("id", "sex", *ages).unpivot(["id", "sex"], ages, "variable", "age")
    return long.select("id", "sex", "age", F.split("variable", "_")[1].cast("int").alias("timepoint"))


def lab_values(raw: DataFrame, fields: Iterable[int], visit_table: DataFrame) -> DataFrame:
    """id, field, feature_name, timepoint, value, sex, age; text that is no number is dropped."""
    long = long_fields(raw, fields).withColumn("value", F.col("value").try_cast("double"))
    long = long.filter(F.col("value").isNotNull()).drop("arr")
    return long.join(visit_table.filter(F.col("age").isNotNull()), ["id", "timepoint"], "left").select(
        "id", "field", "feature_name", "timepoint", "value", "sex", "age"
    )


def socio_values(raw: DataFrame, visit_table: DataFrame, field: int = SOCIO) -> DataFrame:
    """id, sex, age, socio."""
    return lab_values(raw, [field], visit_table).select("id", "sex", "age", F.col("value").alias("socio"))


def parents_survival(raw: DataFrame, sentinels: Iterable[float] | None = None) -> DataFrame:
    """Age at death or last known age of each parent, and whether the parent has died."""
    ages = raw.select(
        F.col("eid").alias("id"),
        row_min(raw, [MOTHER_DEATH], sentinels).alias("mother_age_at_death"),
        row_min(raw, [MOTHER_AGE], sentinels).alias("mother_last_alive"),
        row_min(raw, [FATHER_DEATH], sentinels).alias("father_age_at_death"),
        row_min(raw, [FATHER_AGE], sentinels).alias("father_last_alive"),
    )
    return ages.select(
        "*",
        F.col("mother_age_at_death").isNotNull().alias("mdead"),
        F.coalesce("mother_age_at_death", "mother_last_alive").alias("mfollow_time"),
        F.col("father_age_at_death").isNotNull().alias("fdead"),
        F.coalesce("father_age_at_death", "father_last_alive").alias("ffollow_time"),
    )


def parents_long(parents: DataFrame) -> DataFrame:
    """One row per parent with positive follow-up: id, parent, time, status."""
    def side(name: str, letter: str):
        return F.struct(
            F.lit(name).alias("parent"),
            F.col(f"{letter}follow_time").alias("time"),
            F.col(f"{letter}dead").cast("int").alias("status"),
        )

    others = [c for c in parents.columns if c not in {
        "mother_age_at_death", "mother_last_alive", "father_age_at_death", "father_last_alive",
        "mdead", "mfollow_time", "fdead", "ffollow_time"}]
    rows = parents.select(*others, F.inline(F.array(side("mother", "m"), side("father", "f"))))
    return rows.filter(F.col("time") > 0)


# --- diagnoses ------------------------------------------------------------------------

def event_dates(diagnoses: DataFrame, episodes: DataFrame) -> DataFrame:
    """Hospital diagnoses dated by episode start, or admission where the start is blank."""
    joined = diagnoses.join(episodes.select("eid", "ins_index", "epistart", "admidate"), ["eid", "ins_index"], "left")
    date = parse_day_month_year(F.coalesce(blank_to_null(F.col("epistart")), F.col("admidate")))
    return joined.select(F.col("eid").alias("id"), "diag_icd10", "diag_icd9", date.alias("date"))


def hospital_diagnoses(raw: DataFrame, followup: DataFrame | None, code_names: DataFrame) -> DataFrame:
    """Earliest date per patient, code and version over both hospital sources."""
    parts = [
        paired_fields(raw, ICD10_CODE, ICD10_DATE, ("icd", "date"), ("string", "date")).select(
            "id", "icd", "date", F.lit(10).alias("icd_version")),
    ]
    if raw_columns(raw, [ICD9_CODE]):
        parts.append(
            paired_fields(raw, ICD9_CODE, ICD9_DATE, ("icd", "date"), ("string", "date")).select(
                "id", "icd", "date", F.lit(9).alias("icd_version")))
    if followup is not None:
        both = F.array(
            F.struct(F.col("diag_icd10").alias("icd"), F.lit(10).alias("icd_version")),
            F.struct(F.col("diag_icd9").alias("icd"), F.lit(9).alias("icd_version")),
        )
        rows = followup.select("id", "date", F.inline(both)).filter(blank_to_null(F.col("icd")).isNotNull())
        parts.append(rows.select("id", "icd", "date", "icd_version"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    first = table.groupBy("id", "icd", "icd_version").agg(F.min("date").alias("date"))
    return first.join(
        code_names.select(F.col("coding").alias("icd"), "icd_version", "meaning"), ["icd", "icd_version"], "left")


def self_reported(raw: DataFrame, code_map: DataFrame, code_names: DataFrame) -> DataFrame:
    """Nurse-recorded illnesses with a positive age and a known code: id, icd, age, meaning."""
    pairs = paired_fields(raw, SELF_CODE, SELF_AGE, ("code", "age"), ("string", "double"))
    mapped = pairs.filter(F.col("age") > 0).join(
        code_map.select(F.col("coding").alias("code"), F.col("meaning").alias("icd")), "code")
    return _named(mapped.select("id", "icd", "age"), code_names)


def touchscreen(raw: DataFrame, field_codes: Mapping[int, str], code_names: DataFrame) -> DataFrame:
    """Questions whose answer is the age at an illness, read as that illness's code."""
    ages = long_fields(raw, field_codes.keys()).withColumn("age", F.col("value").try_cast("double"))
    codes = F.create_map(*[x for k, v in field_codes.items() for x in (F.lit(int(k)), F.lit(v))])
    rows = ages.filter(F.col("age") > 1).select("id", codes[F.col("field")].alias("icd"), "age")
    return _named(rows, code_names)


def code_map(events: DataFrame, mapping: DataFrame, code: str) -> DataFrame:
    """Clinic events translated through a code table; blank and unknown codes are dropped."""
    rows = events.filter(blank_to_null(F.col(code)).isNotNull()).select(
        F.col("eid").alias("id"), parse_day_month_year(F.col("event_dt")).alias("date"), F.col(code).alias("coding"))
    return rows.join(mapping, "coding").select("id", F.col("meaning").alias("icd"), "date")


def clinic_diagnoses(events: DataFrame, read2: DataFrame, read3: DataFrame, code_names: DataFrame) -> DataFrame:
    rows = code_map(events, read2, "read_2").unionByName(code_map(events, read3, "read_3"))
    return _named(rows.filter(F.col("date").isNotNull()), code_names)


def _named(rows: DataFrame, code_names: DataFrame) -> DataFrame:
    names = code_names.filter(F.col("icd_version") == 10).select(F.col("coding").alias("icd"), "meaning")
    return rows.join(names, "icd", "left")


def diagnosis_union(
    raw: DataFrame, demog: DataFrame, code_names: DataFrame, hospital_followup: DataFrame | None = None,
    clinic: DataFrame | None = None, self_report: DataFrame | None = None, touch: DataFrame | None = None,
) -> DataFrame:
    """Every diagnosis source in one table: id, icd, icd_version, date, age, meaning, rep.

    Dated sources get an age, sources with an age get a date; only ages above zero stay.
    """
    dob = demog.select("id", "dob")
    names10 = code_names.filter(F.col("icd_version") == 10).select("coding", "meaning")
    dated = hospital_diagnoses(raw, hospital_followup, code_names).withColumn("rep", F.lit("hospital"))
    first = first_occurrences(raw, names10).withColumns({"icd_version": F.lit(10), "rep": F.lit("first_occurrence")})
    dated = dated.unionByName(first)
    if clinic is not None:
        dated = dated.unionByName(clinic.withColumns({"icd_version": F.lit(10), "rep": F.lit("clinic")}))
    dated = dated.withColumn("age", F.lit(None).cast("double"))
    aged = None
    for table, rep in ((self_report, "self_rep_nurse"), (touch, "self_rep_touchscreen")):
        if table is not None:
            tagged = table.withColumns({"icd_version": F.lit(10), "rep": F.lit(rep), "date": F.lit(None).cast("date")})
            aged = tagged if aged is None else aged.unionByName(tagged)
    table = dated if aged is None else dated.unionByName(aged)
    # one join for the birth date serves both directions
    table = table.join(dob, "id", "left")
    by_date = F.col("rep").isin("hospital", "first_occurrence", "clinic")
    table = table.withColumns({
        "age": ifelse(by_date, age_on(F.col("date"), F.col("dob")), F.col("age")),
        "date": ifelse(by_date, F.col("date"), date_at(F.col("age"), F.col("dob"))),
    })
    return table.filter(F.col("age") > 0).select("id", "icd", "icd_version", "date", "age", "meaning", "rep")


# --- code matching and onsets ---------------------------------------------------------

def prefix_lengths(dictionary: DataFrame) -> list[int]:
    """Distinct prefix lengths of a dictionary (as many as codes have characters)."""
    return sorted(r[0] for r in dictionary.filter("subs = 1").select(F.length("icd")).distinct().collect())


def match_codes(diagnosis: DataFrame, dictionary: DataFrame, exact: bool = True) -> DataFrame:
    """Diagnosis rows with every cohort whose code or prefix they match.

    Each event lists its own code and its prefixes of the lengths in use, so one equi-join
    on (version, length, text) finds exact and prefix matches alike.
    """
    lengths = prefix_lengths(dictionary)
    keys = [F.struct(F.lit(n).alias("_len"), F.substring("icd", 1, n).alias("_text")) for n in lengths]
    if exact:
        keys.append(F.struct(F.lit(0).alias("_len"), F.col("icd").alias("_text")))
    if not keys:
        return diagnosis.withColumn("cohort", F.lit(None).cast("string")).filter(F.lit(False))
    wanted = dictionary if exact else dictionary.filter("subs = 1")
    codes = wanted.select(
        "icd_version",
        F.when(F.col("subs") == 1, F.length("icd")).otherwise(0).alias("_len"),
        F.col("icd").alias("_text"),
        "cohort",
    ).distinct()
    events = diagnosis.select("*", F.inline(F.array(*keys)))
    # a code shorter than the prefix length is no match
    events = events.filter((F.col("_len") == 0) | (F.length("_text") == F.col("_len")))
    return events.join(codes, ["icd_version", "_len", "_text"]).select(*diagnosis.columns, "cohort")


def prefix_join(diagnosis: DataFrame, dictionary: DataFrame) -> DataFrame:
    return match_codes(diagnosis, dictionary, exact=False)


def disease_onset(diagnosis: DataFrame, dictionary: DataFrame, cancer_codes: DataFrame | None = None) -> DataFrame:
    """Age and date of the earliest event per patient and cohort.

    The earliest is the one of smallest age, then of earliest date; unknown ones come last.
    Age and date are always those of one event.
    """
    if cancer_codes is not None:
        dictionary = dictionary.unionByName(
            cancer_codes.select("icd", F.lit(0).alias("subs"), F.lit("disease.CANCER").alias("cohort"), "icd_version"))
    hits = match_codes(diagnosis, dictionary)
    event = F.struct(F.col("age").isNull().alias("no_age"), "age", F.col("date").isNull().alias("no_date"), "date")
    first = hits.groupBy("id", "cohort").agg(F.min(event).alias("e"))
    return first.select("id", "cohort", "e.age", "e.date")


def chronic_onset(diagnosis: DataFrame, chronic_codes: DataFrame, cancer_ages: DataFrame | None = None) -> DataFrame:
    """Age at the first chronic disease: a listed code, its three-character parent, or cancer.

    ``chronic_codes`` has icd and icd_version; ``cancer_ages`` has id and age.
    """
    either = F.array_distinct(F.array("icd", F.substring("icd", 1, 3)))
    events = diagnosis.select("id", "age", "icd_version", F.explode(either).alias("icd"))
    hits = events.join(chronic_codes.select("icd", "icd_version"), ["icd", "icd_version"], "left_semi").select("id", "age")
    if cancer_ages is not None:
        hits = hits.unionByName(cancer_ages.select("id", F.col("age").cast("double").alias("age")))
    return hits.groupBy("id").agg(F.min("age").alias("age"))


def self_reported_cancer_ages(raw: DataFrame) -> DataFrame:
    """id, age of each self-reported cancer."""
    return long_fields(raw, [SELF_CANCER_AGE]).select("id", F.col("value").try_cast("double").alias("age"))


def cancer_codes(raw: DataFrame) -> DataFrame:
    """Distinct registry codes: icd, icd_version."""
    long = long_fields(raw, [CANCER_ICD10, CANCER_ICD9])
    version = F.when(F.col("field") == CANCER_ICD10, 10).otherwise(9)
    return long.select(F.col("value").alias("icd"), version.alias("icd_version")).distinct()


def cancer_events(raw: DataFrame, code_names: DataFrame) -> DataFrame:
    """Registry and self-reported cancers: id, coding, age, meaning, source."""
    parts: Sequence[tuple[int, int, int | None, str]] = (
        (CANCER_ICD10, CANCER_AGE, 10, "registry_icd10"),
        (CANCER_ICD9, CANCER_AGE, 9, "registry_icd9"),
        (SELF_CANCER, SELF_CANCER_AGE, None, "self_report"),
    )
    table = None
    for code, age, version, source in parts:
        if not raw_columns(raw, [code]):
            continue
        rows = paired_fields(raw, code, age, ("coding", "age"), ("string", "double")).select(
            "id", "coding", "age", F.lit(version).cast("int").alias("icd_version"), F.lit(source).alias("source"))
        table = rows if table is None else table.unionByName(rows)
    if table is None:
        raise ValueError("the table has no cancer field")
    named = table.join(code_names.select("coding", "icd_version", "meaning"), ["coding", "icd_version"], "left")
    return named.select("id", "coding", "age", "meaning", "source")
