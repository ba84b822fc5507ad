"""Names of the signal features, and what names say: category, reading, dimension, family."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Features of the production category.
PRODUCTION = (
    "sidechain_mod_depth", "sidechain_mod_rate", "sub_bass_ratio", "kick_prominence", "energy_sub_ratio",
    "energy_ratio_low", "energy_ratio_high", "spectral_mod_rate", "spectral_mod_strength", "groove_pump_ratio",
)
#: How names of the tempogram category begin.
TEMPOGRAM = ("fourier_peak", "auto_peak", "cyclic_fourier_", "cyclic_auto_", "tempo_features", "71-", "72-", "73-", "74-", "75-", "76-")

#: Families of classes; a class that is in none is Unaffiliated.
FAMILIES = {
    "High-Energy Bass & Hardcore": ("140 - Deep Dubstep - Grime", "Drum & Bass", "Dubstep", "Hard Dance - Hardcore - Neo Rave", "Hard Techno", "Trap - Future Bass"),
    "Groove & Breaks Cluster": (
        "Bass - Club", "Bass House", "Breaks - Breakbeat - UK Bass", "Deep House", "Electro (Classic - Detroit - Modern)", "House",
        "Indie Dance", "Jackin House", "Minimal - Deep Tech", "Tech House", "UK Garage - Bassline",
    ),
    "Melodic & Atmospheric": (
        "Afro House", "Amapiano", "Downtempo", "Melodic House & Techno", "Organic House", "Progressive House", "Psy-Trance",
        "Techno (Peak Time - Driving)", "Techno (Raw - Deep - Hypnotic)", "Trance (Raw - Deep - Hypnotic)",
    ),
    "Commercial & Mainstage": ("Dance - Pop", "Funky House", "Mainstage", "Nu Disco - Disco", "Trance (Main Floor)"),
}
#: Short names of classes.
SHORT = {
    "Drum & Bass": "D&B", "Breaks - Breakbeat - UK Bass": "Breaks", "140 - Deep Dubstep - Grime": "140/Grime",
    "Techno (Peak Time - Driving)": "Peak Techno", "Techno (Raw - Deep - Hypnotic)": "Deep Techno", "Trance (Main Floor)": "Trance",
    "Trance (Raw - Deep - Hypnotic)": "Deep Trance", "Melodic House & Techno": "Melodic H&T", "Hard Dance - Hardcore - Neo Rave": "Hardcore",
    "Dance - Pop": "Dance Pop", "Electro (Classic - Detroit - Modern)": "Electro", "Ambient - Experimental": "Ambient",
    "Trap - Future Bass": "Trap/Future", "Minimal - Deep Tech": "Minimal", "Bass - Club": "Bass/Club", "Nu Disco - Disco": "Nu Disco",
    "UK Garage - Bassline": "UK Garage", "Hard Techno": "Hard Techno", "Progressive House": "Prog House",
}

#: Features of the two dimensions that no rule of names gives.
ENERGY = (
    "2-Energym", "3-EnergyEntropym", "36-Energystd", "37-EnergyEntropystd", "78-beats_loudness.mean", "79-beats_loudness.stdev", "rms_mean", "rms_std", "rms_skew",
    "rms_kurtosis", "dynamic_range_db", "crest_factor", "energy_variance_8bar", "energy_ratio_low", "energy_ratio_mid", "energy_ratio_high",
)
DANCEABILITY = ("77-danceability", "beat_regularity", "sidechain_mod_depth", "sidechain_mod_rate")


def category(name: Column) -> Column:
    begins = name.startswith(TEMPOGRAM[0])
    for p in TEMPOGRAM[1:]:
        begins = begins | name.startswith(p)
    return F.when(name.isin(*PRODUCTION), "EDM Production & Texture").when(begins, "Tempogram-Based").when(name.startswith("meta."), "Metadata").otherwise("Conventional MIR")


def readable(name: Column) -> Column:
    """Without a leading number and dash, underscores as spaces, each word capitalised."""
    return F.initcap(F.replace(F.regexp_replace(name, r"^\d[^-]*-", ""), F.lit("_"), F.lit(" ")))


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[key], default)


def family(genre: Column) -> Column:
    return _lookup({g: f for f, genres in FAMILIES.items() for g in genres}, genre, F.lit("Unaffiliated"))


def short(genre: Column) -> Column:
    return _lookup(SHORT, genre, genre)


def dimension(name: str) -> str | None:
    """The profile dimension of a feature name; None for what belongs to none."""
    if name in ENERGY:
        return "energy"
    if name in DANCEABILITY:
        return "danceability"
    number = int(m[1]) if (m := re.match(r"(\d+)-", name)) else 0
    if name == "meta.Bpm" or 69 <= number <= 76 or re.fullmatch(r"(fourier|auto)_peak\d_bpm", name):
        return "tempo"
    if 22 <= number <= 34 or 56 <= number <= 68 or name.startswith("hp_ratio"):
        return "harmonic"
    if 80 <= number <= 92 or name in ("percussive_onset_density", "kick_prominence") or re.match(r"(fourier_peak|auto_peak|cyclic_)", name):
        return "rhythmic"
    if 1 <= number <= 55 or name.startswith("spectral_") or name == "sub_bass_ratio":
        return "texture"
    return None


def dimensions(names: list[str]) -> dict[str, list[int]]:
    """Places of the names of each dimension, as profiles take them."""
    out: dict[str, list[int]] = {d: [] for d in ("energy", "danceability", "tempo", "harmonic", "rhythmic", "texture")}
    for i, n in enumerate(names):
        if d := dimension(n):
            out[d].append(i)
    return out
