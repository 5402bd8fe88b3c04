"""Fixed values and schemas of evidence scoring: thresholds, bands, markers, reference tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


#: The defaults below are those of the scoring rules.
@dataclass(frozen=True)
class Params:
    """Thresholds of the scoring rules; operators take an instance, so that all of them can be overridden."""

    elevated: float = 0.45
    global_cause_parts: int = 3
    global_cause_factor: float = 0.85
    multiplicity_floor: float = 0.55
    multiplicity_step: float = 0.09
    min_height: int = 64
    min_height_factor: float = 0.35
    item_height_factor: float = 0.6
    min_blur: float = 60.0
    blur_factor: float = 0.7
    min_luma: float = 40.0
    max_luma: float = 215.0
    luma_factor: float = 0.8
    min_quality: int = 70
    quality_factor: float = 0.6
    uncalibrated_factor: float = 0.85
    no_part_factor: float = 0.5
    marker_floor: float = 0.88
    manifest_clamp: float = 0.35
    tail_reference: float = 1.2
    noise_reference: float = 0.9
    grid_reference: float = 0.35
    max_parts: int = 10
    eval_parts: int = 3
    min_samples: int = 20
    target_fprs: tuple[float, ...] = (0.01, 0.001)
    bins: int = 10
    resamples: int = 500
    logit_eps: float = 1e-6
    nll_eps: float = 1e-7
    media_ttl_hours: int = 24
    sweep_limit: int = 500
    attempts: int = 2


PARAMS = Params()

#: Bands of a score by their lower bounds; each ends where the next begins, the last at 1 inclusive.
BANDS = [
    ("low", 0.0, 0.2, "Low indication"),
    ("weak", 0.2, 0.45, "Weak indication"),
    ("mixed", 0.45, 0.7, "Mixed signals"),
    ("strong", 0.7, 0.88, "Strong indication"),
    ("very_strong", 0.88, 1.0, "Very strong indication"),
]
#: Words that no band's label may hold, and phrases that no conclusion may.
FORBIDDEN_WORDS = ["fake", "real", "authentic", "genuine", "verdict"]
FORBIDDEN_PHRASES = [
    "is fake", "is real", "is genuine", "is authentic", "is a deepfake", "was manipulated", "has been manipulated",
    "confirmed fake", "confirmed manipulation", "definitely", "proves", "proof that", "we can confirm",
]
#: Markers that name a generator, first match wins; editors.
GENERATORS = [
    ("stable diffusion", "Stable Diffusion"), ("stablediffusion", "Stable Diffusion"), ("midjourney", "Midjourney"), ("dall-e", "DALL·E"), ("dalle", "DALL·E"),
    ("firefly", "Adobe Firefly"), ("imagen", "Google Imagen"), ("flux", "FLUX"), ("novelai", "NovelAI"), ("invokeai", "InvokeAI"),
    ("automatic1111", "AUTOMATIC1111"), ("comfyui", "ComfyUI"),
]
EDITORS = [(x, x) for x in ("photoshop", "gimp", "lightroom", "affinity photo", "pixelmator")]
#: Accepted media types of uploads.
ACCEPTED = ["image/jpeg", "image/png", "image/webp", "image/bmp"]
#: Suffixes of members that are media.
SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]
#: The standard luminance quantisation table.
STANDARD_QUANT = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
#: Temperatures tried: fine below 1, coarse from there on.
TEMPERATURES = [(5 + i) / 100 for i in range(95)] + [(100 + 5 * i) / 100 for i in range(181)]

#: Report text by the pattern of an item's parts: a headline and what it means. {n} parts, {k} of them elevated, {label} of the band.
TEXTS = {
    "no_part": ("Nothing to analyse: no part was found", "Detectors look at parts, and this item shows none. It was not examined; that is no sign of a clean item."),
    "single_part": ("{label}, from one part", "The item has one part, and its band is the item's: {label}."),
    "none_elevated": ("None of {n} parts is elevated", "Each of the {n} parts was scored by itself, and none reaches the level worth a note. Methods unknown to the detectors may still have left no trace."),
    "single_outlier": ("{k} of {n} parts is elevated", "One part stands out from {n}. With many parts one of them may do so by chance, and confidence was lowered for that."),
    "all_elevated": ("All of {n} parts are elevated alike", "All {n} parts score high together. A common cause, such as processing of the whole item, explains that better than work on each part."),
    "several_elevated": ("{k} of {n} parts are elevated", "{k} of {n} parts reach the level worth a note. Size, blur or light of parts may be the cause as well as changes to some of them."),
}
#: What to do next, by whether there is no part, no elevated part, or some.
NEXT_STEPS = {
    "no_part": "Try a copy in which the parts are larger and sharper.",
    "quiet": "These scores ask for nothing. If something else raises doubt, look for the source: it tells more than a score.",
    "raised_one": "Look at the elevated part and then for the source: who published the item, when, and in which earlier form.",
    "raised": "Look at the elevated parts ({k}) and then for the source: who published the item, when, and in which earlier form.",
}

PENALTY = T.StructType([T.StructField("reason", T.StringType()), T.StructField("factor", T.DoubleType())])
INTERVAL = T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
BAND_SCHEMA = "band string, min double, max double, label string, last boolean"
SAMPLE_SCHEMA = "key string, label int, spatial double, frequency double, provenance_fired boolean, faces_found int, dataset string"
MANIFEST_SCHEMA = "active_manifest string, manifests map<string, struct<signature_info: struct<issuer: string, common_name: string>>>, validation_status array<struct<code: string>>"
