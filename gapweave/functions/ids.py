"""Identifiers, labels and stable hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def normalize_id(c: Column) -> Column:
    """Trimmed id without a trailing `.0`; empty for null."""
    return F.regexp_replace(text(c), r"\.0$", "")


def animal_key(c: Column) -> Column:
    """The id as a join key: upper case, no spaces."""
    return F.replace(F.upper(normalize_id(c)), F.lit(" "), F.lit(""))


def hash01(c: Column) -> Column:
    """The first 48 bits of the MD5 of the value's text, as a fraction in [0, 1)."""
    head = F.conv(F.substring(F.md5(c.cast("string")), 1, 12), 16, 10)
    return head.cast("double") / F.lit(float(1 << 48))


def make_uid(*parts: Column) -> Column:
    """A readable prefix of the first four parts and twelve hex digits over all of them."""
    shown = [F.translate(p.cast("string"), " /", "--") for p in parts[:4]]
    digest = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)
    return F.concat_ws("_", *shown, digest)


#: What sources call a sex, and what stands for no age.
SEXES = {"female": ("f", "female", "fem", "\u2640"), "male": ("m", "male", "\u2642")}
NO_AGE = ("", "nan", "none", "unknown", "na", "n/a")


def sex_label(c: Column) -> Column:
    v = F.lower(text(c))
    return F.when(v.isin(*SEXES["female"]), "female").when(v.isin(*SEXES["male"]), "male").otherwise("unknown")


def age_label(c: Column) -> Column:
    """subadult, adult, unknown, or the source's own word."""
    v = F.lower(text(c))
    young = v.contains("sub") | v.contains("juv")
    return F.when(v.isin(*NO_AGE), "unknown").when(young, "subadult").when(v.contains("adult") | (v == "a"), "adult").otherwise(v)


def suffix_sex(c: Column) -> Column:
    """The sex that the last letter of an id tells, as in 121F."""
    last = F.right(animal_key(c), F.lit(1))
    return F.when(last == "F", "female").when(last == "M", "male").otherwise("unknown")


def code_labels(c: Column) -> tuple[Column, Column]:
    """Sex and taxon of a collar code: F or M for the sex, then L for leopards; others are tigers."""
    key = animal_key(c)
    first = F.substring(key, 1, 1)
    sex = F.when(first == "F", "female").when(first == "M", "male").otherwise("unknown")
    return sex, F.when(sex == "unknown", "unknown").when(F.substring(key, 2, 1) == "L", "leopard").otherwise("tiger")


def appended(sources: Column, label: str, here: Column) -> Column:
    """A list of sources, `;` between, with one more where `here` holds; `unknown` and nothing are no source."""
    none = sources.isNull() | sources.isin("", "unknown")
    return F.when(here, F.when(none, F.lit(label)).otherwise(F.concat_ws(";", sources, F.lit(label)))).otherwise(sources)


def known_label(c: Column) -> Column:
    """Null, empty and `nan` as unknown."""
    return F.when(c.isNull() | (c == "") | (F.lower(c) == "nan"), "unknown").otherwise(c)


def setting_minutes(c: Column) -> tuple[Column, Column]:
    """Coarse and fine minutes of a setting's name such as 240min_to_60min; null for other names."""
    at = lambda i: F.nullif(F.regexp_extract(c, r"^([0-9]+)min_to_([0-9]+)min$", i), F.lit("")).cast("int")
    return at(1), at(2)


#: The species of each taxon, and the habitat of each study.
SPECIES = {"puma": "puma_concolor", "cougar": "puma_concolor", "bobcat": "lynx_rufus", "tiger": "panthera_tigris", "leopard": "panthera_pardus"}
GENUS = {"puma": "puma", "cougar": "puma", "bobcat": "lynx", "tiger": "panthera", "leopard": "panthera"}


def mapped(c: Column, values: dict[str, str]) -> Column:
    """The value that the map gives for c, c itself where it gives none."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def transfer_relation(species_a: Column, habitat_a: Column, species_b: Column, habitat_b: Column) -> Column:
    """How a source relates to a target by species and habitat; null, empty and `nan` are unknown."""
    species = F.when(known_label(species_a) == known_label(species_b), "same_species").otherwise("different_species")
    habitat = F.when(known_label(habitat_a) == known_label(habitat_b), "same_habitat").otherwise("different_habitat")
    return F.concat_ws("_", species, habitat)
