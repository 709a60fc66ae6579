"""Column expressions of the manifest, admission and explanation rules: Column in, Column out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Train and validation shares of the group-hash split; the rest is test. The bucket's upper end is 1 itself.
SPLIT_RATIOS = (("train", 0.70), ("val", 0.85))
#: Thresholds of explanation bands and of risk levels.
BAND_HIGH, BAND_LOW, RISK_LOW, RISK_MEDIUM = 0.65, 0.35, 0.3, 0.6
#: Typographic characters and their plain forms.
PLAIN_FORMS = {"—": "--", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", " ": " ", "•": "*", "×": "x"}
#: Accepted extensions by media type, and accepted licences.
IMAGE_EXTENSIONS, VIDEO_EXTENSIONS = ("jpg", "jpeg", "png", "webp"), ("mp4", "mov", "avi", "mkv")
ACCEPTED_MIMES = ("image/jpeg", "image/png")
ACCEPTED_LICENSES = ("cc0", "pd", "public domain", "cc-by", "cc-by-sa")


def harmonise_label(label: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped label; null where the mapping has none."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), label.cast("string"))


def fake_real_pair(scores: Column) -> Column:
    """struct(fake, real, label) of a label -> probability map: the first key that holds each word; an error if either is missing."""
    entries = F.map_entries(scores)

    def first(word: str) -> Column:
        hits = F.filter(entries, lambda e: F.lower(e["key"]).contains(word))
        return F.when(F.size(hits) > 0, hits[0]["value"]).otherwise(F.raise_error(F.lit(f"no {word} label")).cast("double"))

    fake, real = first("fake"), first("real")
    return F.struct(fake.alias("fake"), real.alias("real"), F.when(fake >= real, "fake").otherwise("real").alias("label"))


def split_bucket(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def assign_split(key: Column, ratios: Sequence[tuple[str, float]] = SPLIT_RATIOS, rest: str = "test") -> Column:
    """Split by the hash of a group's key, so that no group is in two."""
    bucket, out = split_bucket(key), F.lit(rest)
    for name, upper in reversed(ratios):
        out = F.when(bucket < upper, name).otherwise(out)
    return out


def classify_framing(prompt: Column) -> Column:
    return F.when(prompt.contains("close-up"), "close-up").when(prompt.contains("wide shot"), "wide").otherwise("mid")


def clean_attribution(category: Column, license_name: Column, artist: Column, url: Column) -> tuple[Column, Column]:
    """(category without its prefix, attribution line with its source)."""
    who = F.when(F.lower(license_name) == "cc0", F.lit("Public domain (CC0)")).otherwise(F.coalesce(artist, F.lit("unknown")))
    return F.regexp_replace(category, "^Category:", ""), F.concat(who, F.lit(" - "), url)


def normal_license(license_name: Column) -> Column:
    return F.nullif(F.trim(F.lower(license_name)), F.lit(""))


def admitted(license_name: Column, mime: Column, width: Column, height: Column, accepted=ACCEPTED_LICENSES, mimes=ACCEPTED_MIMES, least: int = 300) -> Column:
    """Whether an item may be taken: an accepted licence, a type of natural photographs, and both sides long enough. Anything unknown is refused, never null."""
    fits = normal_license(license_name).isin(*accepted) & mime.isin(*mimes) & (width >= least) & (height >= least)
    return F.coalesce(fits, F.lit(False))


def stable_id(title: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(title), 1, n)


def bounded_side(side: Column, longest: Column, max_side: int = 1600) -> Column:
    """A side after the longest is brought down to max_side."""
    return F.when(longest > max_side, F.greatest(F.lit(1), F.floor(side * (F.lit(float(max_side)) / longest)).cast("int"))).otherwise(side.cast("int"))


def crop_box(width: Column, height: Column) -> tuple[Column, Column, Column]:
    """(side, left, top) of the centred square."""
    side = F.least(width, height)
    return side, F.floor((width - side) / 2).cast("int"), F.floor((height - side) / 2).cast("int")


def reroot_path(path: Column, subdir: str, cls: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(F.lit(subdir + "/"), cls, F.lit("/"), stem, F.lit(".jpg"))


def squash(x: Column, kind: str, scale: float = 1.0) -> Column:
    """Saturating maps to [0, 1]: ratio x/(x+scale), share x/scale, above (x-0.9)/0.1; clipped."""
    y = {"ratio": x / (x + scale), "share": x / scale, "above": (x - 0.9) / 0.1}[kind]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), y))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def linear_logit(vector: Column, weights: Sequence[float], bias: float, mean: Sequence[float] | None = None, std: Sequence[float] | None = None) -> Column:
    """bias + sum of weights * (vector - mean) / std, in the executor's generated code."""
    if mean is not None:
        scaled = [w / s for w, s in zip(weights, std, strict=True)]
        bias = bias - sum(w * m for w, m in zip(scaled, mean, strict=True))
        weights = scaled
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(float(bias)), lambda acc, x: acc + x)


def band(score: Column, high: float = BAND_HIGH, low: float = BAND_LOW) -> Column:
    return F.when(score >= high, "high").when(score <= low, "low").otherwise("medium")


def risk(score: Column, low: float = RISK_LOW, medium: float = RISK_MEDIUM) -> Column:
    return F.when(score < low, "low").when(score < medium, "medium").otherwise("high")


def headline(verdict: Column, risk_level: Column) -> Column:
    #: The four headlines.
    return (
        F.when((verdict == "suspicious") & (risk_level == "high"), "Verdict: LIKELY AI GENERATED / MANIPULATED")
        .when(verdict == "suspicious", "Verdict: SUSPICIOUS — possible manipulation detected")
        .when(risk_level == "low", "Verdict: AUTHENTIC — no significant signs of manipulation detected")
        .otherwise("Verdict: LIKELY AUTHENTIC — minor inconsistencies detected, likely not manipulation")
    )


def latin1_text(text: Column) -> Column:
    for a, b in PLAIN_FORMS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"[^\x00-\xFF]", "")


def even_indices(total: Column, count: int) -> Column:
    """At most count indexes spread over 0..total-1; the step is divided first, in double."""
    step = total.cast("double") / F.lit(float(count))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * step).cast("int")))
    return F.when(total <= 0, F.array().cast("array<int>")).when(F.lit(count) >= total, F.sequence(F.lit(0), (total - 1).cast("int"))).otherwise(spread)


def frame_time(index: Column, fps: Column) -> Column:
    return F.when(fps > 0, index / fps).otherwise(F.lit(0.0))


def duration(frames: Column, fps: Column) -> Column:
    return F.when((fps > 0) & frames.isNotNull(), frames / fps)


def client_key(forwarded: Column, host: Column, trust_proxy: bool) -> Column:
    direct = F.coalesce(host, F.lit("unknown"))
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), direct) if trust_proxy else direct


def normal_path(path: Column) -> Column:
    """Path with . and .. resolved; going above the root leaves a leading .. ."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    resolved = F.aggregate(
        parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    )
    return F.concat(F.lit("/"), F.array_join(resolved, "/"))


def within_root(path: Column, root: str) -> Column:
    p = normal_path(path)
    return (p == root) | p.startswith(root.rstrip("/") + "/")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), "[^A-Za-z0-9._-]", "_")


def media_type(name: Column, images: Sequence[str] = IMAGE_EXTENSIONS, videos: Sequence[str] = VIDEO_EXTENSIONS) -> Column:
    """image, video or null by the extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(extension.isin(*images), "image").when(extension.isin(*videos), "video")
