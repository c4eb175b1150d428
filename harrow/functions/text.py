"""Column functions over names, labels and file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a plant condition and an animal pest; tokens of life stages in order; other names of crops; markers of a copy.
CONDITION_HINTS = (
    "blight", "rust", "mildew", "mould", "mold", "rot", "wilt", "smut", "scab", "anthracnose", "canker", "blast", "spot", "spots", "curl", "mosaic",
    "chlorosis", "necrosis", "lesion", "fungus", "fungal", "bacterial", "virus", "viral", "phytophthora", "fusarium", "alternaria", "cercospora",
    "colletotrichum", "septoria", "puccinia", "erysiphe", "oidium", "downy", "powdery", "damping", "gall", "scorch", "yellowing", "dieback",
    "die_back", "deficiency",
)
PEST_HINTS = (
    "aphid", "beetle", "borer", "bug", "caterpillar", "cricket", "cutworm", "fly", "grub", "hopper", "larva", "larvae", "locust", "maggot", "mite",
    "moth", "nymph", "pest", "scale", "slug", "snail", "termite", "thrip", "weevil", "whitefly", "worm", "armyworm", "bollworm", "mealybug",
    "grasshopper", "sawfly", "wasp", "ant", "earwig", "insect", "spider",
)
STAGES = {"larva": "larva", "larvae": "larva", "caterpillar": "larva", "grub": "larva", "nymph": "nymph", "egg": "egg", "adult": "adult", "imago": "adult"}
SYNONYMS = {
    "corn": "maize", "corn maize": "maize", "zea mays": "maize", "vitis": "grape", "grapes": "grape", "vitis vinifera": "grape", "bell pepper": "chilli", "pepper": "chilli", "pepper bell": "chilli", "capsicum": "chilli", "chili": "chilli",
    "chile": "chilli", "paddy": "rice", "solanum lycopersicum": "tomato", "citrus fruits": "citrus", "orange": "citrus", "mandarin": "citrus", "soya": "soybean", "soya bean": "soybean", "glycine max": "soybean",
}
COPY_MARKS = r"(?i)(__sev-[a-z]+)|(_aug\d*)|(_copy\d*)|(_rot\d+)|(_flip[a-z]*)|(_mirror)"
HEALTHY_WORDS = ("healthy", "health", "normal", "fresh")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
SPLIT_DIRS = ("train", "training", "val", "valid", "validation", "test", "testing", "images")


def normalise(name: Column) -> Column:
    """Lower case, everything but letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def fold_synonyms(name: Column, synonyms=None) -> Column:
    key = normalise(name)
    m = F.create_map(*[F.lit(x) for kv in (synonyms or SYNONYMS).items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), key)


def strip_prefix(label: Column, *crops: Column) -> Column:
    """The label's words without each crop's words at the front, in turn, as long as words remain."""
    out = normalise(label)
    for crop in crops:
        lead = F.concat(normalise(crop), F.lit(" "))
        out = F.when((F.length(lead) > 1) & F.startswith(out, lead), F.substring(out, F.length(lead) + 1, F.length(out))).otherwise(out)
    return out


def _hinted(words: Column, hints) -> Column:
    long = [h for h in hints if len(h) >= 4]
    whole = F.arrays_overlap(words, F.array(*[F.lit(h) for h in hints]))
    return whole | F.exists(words, lambda w: F.exists(F.array(*[F.lit(h) for h in long]), lambda h: F.contains(w, h)))


def looks_like_condition(name: Column) -> Column:
    """Words name a plant condition and no pest. Hints of four letters or more count inside a word too."""
    words = F.split(normalise(name), " ")
    return _hinted(words, CONDITION_HINTS) & ~_hinted(words, PEST_HINTS)


def life_stage(name: Column) -> Column:
    padded, out = F.concat(F.lit(" "), normalise(name), F.lit(" ")), None
    for token, stage in STAGES.items():
        test = F.contains(padded, F.lit(f" {token} "))
        out = F.when(test, stage) if out is None else out.when(test, stage)
    return out.otherwise("unknown")


def strip_stage(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, rf"(?i)\b({'|'.join(STAGES)})\b", " "), r"\s+", " "))


def severity(stem: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(stem, r"(?i)__sev-(none|low|moderate|severe)", 1)), F.lit("")), F.lit("unknown"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def group_key(path: Column) -> Column:
    """Folder and stem without marks of a copy and trailing separators; the stem itself if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(stem(path), COPY_MARKS, ""), r"[\s_-]+$", "")
    return F.concat(parent(path), F.lit("/"), F.coalesce(F.nullif(bare, F.lit("")), stem(path)))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)).isin(*IMAGE_SUFFIXES)
