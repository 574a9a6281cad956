"""Individual metadata: which column names the animal, and the labels it adds to tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gapweave.functions.ids import GENUS, SPECIES, age_label, animal_key, appended, code_labels, mapped, sex_label, suffix_sex, text


def key_column(meta: DataFrame, tracks: DataFrame, preferred: Sequence[str] = ("animal_id", "id", "name", "collar", "idcollar")) -> str | None:
    """The metadata column whose keys most animals have; ties go to preferred names, then names with `id`, then fuller columns."""
    keys = tracks.select(animal_key(F.col("animal_id")).alias("_key")).distinct()
    best = None
    for c in meta.columns:
        own = meta.select(animal_key(F.col(f"`{c}`")).alias("_key")).filter("_key <> ''")
        score = (own.distinct().join(keys, "_key", "left_semi").count(), c.lower() in preferred, "id" in c.lower(), own.count())
        if score[0] and (best is None or score > best[0]):
            best = (score, c)
    return best and best[1]


def attach(tracks: DataFrame, meta: DataFrame, key: str, sex: str | None = None, age: str | None = None, species: str | None = None, order: str | None = None) -> DataFrame:
    """Tracks with sex, age_class, species_id, genus_group, habitat_id and where they are from.

    Of several rows of an animal the first by `order` counts. A known value goes before
    the track's own, then before the default.
    """
    pick = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    w = Window.partitionBy("_key").orderBy(F.col(f"`{order or key}`"))
    rows = meta.withColumn("_key", animal_key(pick(key))).select("_key", sex_label(pick(sex)).alias("_sex"), age_label(pick(age)).alias("_age"), F.nullif(text(pick(species)), F.lit("")).alias("_species"), F.row_number().over(w).alias("_r"))
    joined = tracks.withColumn("_key", animal_key(F.col("animal_id"))).join(rows.filter("_r = 1").drop("_r"), "_key", "left")
    known = lambda c: F.nullif(c, F.lit("unknown"))
    own = lambda c, f: known(f(F.col(c))) if c in tracks.columns else F.lit(None).cast("string")
    out = joined.withColumns(
        {
            "sex": F.coalesce(known(F.col("_sex")), own("sex", sex_label), F.lit("unknown")), "age_class": F.coalesce(known(F.col("_age")), own("age_class", age_label), F.lit("unknown")),
            "species_id": F.coalesce(F.col("_species"), mapped(F.col("taxon"), SPECIES)), "genus_group": mapped(F.col("taxon"), GENUS), "habitat_id": F.col("dataset"),
            "metadata_source": F.when(F.col("_sex").isNotNull(), "table").otherwise("unknown"),
        }
    )
    return out.withColumn("transfer_unit", F.concat_ws("__", "species_id", "habitat_id")).drop("_key", "_sex", "_age", "_species")


#: Habitats of data sets, the taxon that a data set is of, and collars of known sex and taxon.
HABITATS = {"SantaCruz_puma": "SantaCruz", "Thailand_tiger_leopard": "Thailand_WEFCOM", "Olympic_cougar": "OlympicPeninsula", "Olympic_bobcat": "OlympicPeninsula"}
TAXA = {"SantaCruz_puma": "puma", "Olympic_cougar": "cougar", "Olympic_bobcat": "bobcat"}
BY_COLLAR = "Thailand_tiger_leopard"
COLLARS = {
    "31899": ("female", "leopard"), "31898": ("male", "leopard"), "37821": ("male", "leopard"), "37822": ("male", "leopard"), "37823": ("male", "leopard"),
    "131343": ("female", "tiger"), "229011": ("female", "tiger"), "229041": ("female", "tiger"), "229012": ("male", "tiger"), "229022": ("male", "tiger"), "229032": ("male", "tiger"),
}
SPECIES_WORDS = (("tiger", "tiger"), ("leopard", "leopard"), ("bobcat", "bobcat"), ("cougar|puma", "cougar"))


def cascade(tracks: DataFrame, meta: DataFrame | None = None, key: str | None = None, sex: str | None = None, age: str | None = None,
            species: str | None = None, code: str | None = None, name: str = "table") -> DataFrame:
    """Tracks with sex, age_class, taxon, species, habitat and transfer labels, and where they are from.

    In order: the id's last letter (pumas always, other data sets of one taxon where the sex is
    unknown), the metadata table (what it knows goes before what was there; collar codes count
    in the data set named by collar only), then known collars. Rows of the table that share a key
    count once, by the least labels; the table is named once for each label it gave. An animal without any of these keeps `unknown`.
    """
    data, animal = F.col("dataset"), animal_key(F.col("animal_id"))
    own = lambda c, f: f(F.col(c)) if c in tracks.columns else F.lit("unknown")
    puma, olympic, collared = (data == "SantaCruz_puma") | (F.col("taxon") == "puma"), data.isin("Olympic_cougar", "Olympic_bobcat"), data == BY_COLLAR
    taxon = F.when(puma, "puma").otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TAXA.items() for x in kv]), data), F.col("taxon"), F.when(collared, "tiger")))
    x = tracks.withColumns({"_puma": F.coalesce(puma, F.lit(False)), "_key": animal, "taxon": taxon, "sex": own("sex", sex_label), "age_class": own("age_class", age_label), "metadata_source": F.lit("default")})
    told = suffix_sex(F.col("animal_id"))
    hit = (told != "unknown") & (F.col("_puma") | (olympic & (F.col("sex") == "unknown")))
    x = x.withColumns({"metadata_source": appended(F.col("metadata_source"), F.when(F.col("_puma"), "puma_id_suffix").otherwise("id_suffix"), hit), "sex": F.when(hit, told).otherwise(F.col("sex"))})
    if meta is not None and key:
        x = from_table(x, meta, key, sex, age, species, code, name)
    collar = F.try_element_at(F.create_map(*[v for k, (s, t) in COLLARS.items() for v in (F.lit(k), F.struct(F.lit(s).alias("sex"), F.lit(t).alias("taxon")))]), F.col("_key"))
    x = x.withColumn("_collar", F.when(collared, collar))
    known = F.col("_collar").isNotNull()
    x = x.withColumns({"metadata_source": appended(F.col("metadata_source"), "known_thailand_collars", known), "sex": F.when(known & (F.col("sex") == "unknown"), F.col("_collar.sex")).otherwise(F.col("sex")), "taxon": F.when(known, F.col("_collar.taxon")).otherwise(F.col("taxon"))})
    x = x.withColumn("taxon", F.when(collared & ~F.col("taxon").eqNullSafe("leopard"), "tiger").otherwise(F.col("taxon")))
    x = x.withColumns({"habitat_id": mapped(data, HABITATS), "species_common_name": F.col("taxon"), "species_id": mapped(F.col("taxon"), SPECIES), "genus_group": mapped(F.col("taxon"), GENUS)})
    x = x.withColumns({"study_system": F.col("habitat_id"), "species_group": F.col("species_id"), "transfer_unit": F.concat_ws("__", "species_id", "habitat_id")})
    flags = {"sex_female": ("sex", "female"), "sex_male": ("sex", "male"), "age_adult": ("age_class", "adult"), "age_subadult": ("age_class", "subadult")}
    return x.withColumns({c: (F.col(of) == v).cast("double") for c, (of, v) in flags.items()}).drop("_puma", "_key", "_collar")


def from_table(x: DataFrame, meta: DataFrame, key: str, sex: str | None, age: str | None, species: str | None, code: str | None, name: str) -> DataFrame:
    pick = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    word = F.lower(text(pick(species)))
    taxon = F.coalesce(*[F.when(word.rlike(p), t) for p, t in SPECIES_WORDS])
    code_sex, code_taxon = code_labels(pick(code))
    known = lambda c: F.nullif(c, F.lit("unknown"))
    labels = F.struct(known(sex_label(pick(sex))).alias("sex"), known(age_label(pick(age))).alias("age"), taxon.alias("taxon"), known(code_sex).alias("code_sex"), known(code_taxon).alias("code_taxon"))
    rows = meta.select(animal_key(pick(key)).alias("_key"), labels.alias("_l")).filter("_key <> ''").groupBy("_key").agg(F.min("_l").alias("_m"))
    x = x.join(rows, "_key", "left")
    coded = F.col("dataset") == BY_COLLAR
    sex_, taxon_ = F.coalesce("_m.sex", F.when(coded, F.col("_m.code_sex"))), F.coalesce(F.when(coded, F.col("_m.code_taxon")), F.col("_m.taxon"))
    source = F.col("metadata_source")
    for label in (sex_, F.col("_m.age"), taxon_):
        source = appended(source, name, label.isNotNull())
    return x.withColumns({"metadata_source": source, "sex": F.coalesce(sex_, "sex"), "age_class": F.coalesce("_m.age", "age_class"), "taxon": F.coalesce(taxon_, "taxon")}).drop("_m")
