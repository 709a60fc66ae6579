"""Provenance signals from tags, text and signed-manifest JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of generators, in order; declarations of synthetic origin; fields that a camera writes.
GENERATORS = (
    "stable diffusion", "stablediffusion", "sd-webui", "automatic1111", "comfyui", "midjourney", "dall-e", "dalle", "openai", "firefly", "adobe firefly",
    "novelai", "imagen", "flux", "ideogram", "leonardo.ai", "playground ai", "craiyon", "dreamstudio", "invokeai", "fooocus", "diffusers",
)
DECLARATIONS = ("trainedalgorithmicmedia", "compositesynthetic", "algorithmicmedia")
SOFTWARE_TAGS = ("Software", "ProcessingSoftware", "HostComputer", "Artist")
TEXT_KEYS = ("parameters", "prompt", "workflow", "sd-metadata", "software")
XMP_KEYS = ("xmp", "xml:com.adobe.xmp")
XMP_PROPERTIES = ("xmp:creatortool", "tiff:software", "dc:creator", "photoshop:credit", "exif:software", "digitalsourcetype")
CAPTURE_FIELDS = ("ExposureTime", "FNumber", "ISOSpeedRatings", "FocalLength", "DateTimeOriginal")


def software_fields(tags: DataFrame, media: str, key: str, value: str, names=SOFTWARE_TAGS, text_keys=TEXT_KEYS, properties=XMP_PROPERTIES) -> DataFrame:
    """media, fields: what may name the producing tool, in lower case: some tags, text chunks as "key value", and of an XMP payload its software properties only.

    Tags first, then text chunks, then properties in their order. Tags of a file are few, so they are collected.
    """
    k = F.lower(F.col(key))
    field = lambda kind, pos, text: F.struct(F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), F.col(key).alias("key"), text.alias("text"))
    of_property = lambda pos: lambda v: field(2, pos, v)  # noqa: E731  one parameter: a second would be the element's index
    in_xmp = [F.transform(xmp_property(F.col(value), p), of_property(i)) for i, p in enumerate(properties)]
    own = F.when(F.col(key).isin(*names), F.array(field(0, 0, F.col(value)))).when(k.isin(*text_keys), F.array(field(1, 0, F.concat_ws(" ", F.col(key), F.col(value))))).when(k.isin(*XMP_KEYS), F.concat(*in_xmp))
    rows = tags.select(F.col(media), F.explode(own).alias("f"))
    return rows.groupBy(media).agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda e: e["text"]), " ")).alias("fields"))


def xmp_property(blob: Column, name: str) -> Column:
    """Values of an XMP property, as an attribute or an element with or without attributes."""
    return F.concat(F.regexp_extract_all(blob, F.lit(f'(?is){name}\\s*=\\s*"([^"]*)"'), 1), F.regexp_extract_all(blob, F.lit(f"(?is)<{name}(?:\\s[^>]*)?>(.*?)</{name}>"), 1))


def match_marker(text: Column, markers=GENERATORS) -> Column:
    """The first marker of the list that stands in the text with no letter or digit beside it; null if none does."""
    hits = [F.when(text.rlike(f"(?<![a-z0-9])\\Q{m}\\E(?![a-z0-9])"), F.lit(m)) for m in markers]
    return F.coalesce(*hits)


def synthetic_declaration(text: Column, markers=DECLARATIONS) -> Column:
    squeezed = F.regexp_replace(F.lower(text), r"[\s_-]", "")
    return F.coalesce(*[F.when(squeezed.contains(m), F.lit(m)) for m in markers])


def ai_metadata_signal(df: DataFrame, media: str, text: Column, markers=GENERATORS, declarations=DECLARATIONS) -> DataFrame:
    declared, marker = synthetic_declaration(text, declarations), match_marker(F.lower(text), markers)
    return df.select(media, F.when(declared.isNotNull(), 1.0).when(marker.isNotNull(), 0.95).alias("score"), F.coalesce(declared, marker).alias("evidence"))


def camera_signal(tags: DataFrame, media: str, key: str, makers=("Make", "Model"), fields=CAPTURE_FIELDS) -> DataFrame:
    g = tags.groupBy(media).agg(F.bool_or(F.col(key).isin(*makers)).alias("maker"), F.countDistinct(F.when(F.col(key).isin(*fields), F.col(key))).alias("fields"))
    return g.select(media, F.when(~F.col("maker"), None).when(F.col("fields") >= 3, 0.35).otherwise(0.45).alias("score"))


MANIFEST = "struct<validation_status:array<struct<code:string>>,active_manifest:string,manifests:map<string,struct<claim_generator:string,synthetic:boolean>>>"


def manifest_signal(df: DataFrame, media: str, json_col: str) -> DataFrame:
    m = F.from_json(json_col, MANIFEST)
    x = df.select(media, m.alias("m"), F.try_element_at(m["manifests"], m["active_manifest"]).alias("a"))
    bad = F.coalesce(F.size("m.validation_status") > 0, F.lit(False))
    score = F.when(F.col("m").isNull() | F.col("m.manifests").isNull(), None).when(bad, 0.95).when(F.col("a.synthetic"), 1.0).otherwise(0.15)
    codes = F.array_join(F.slice(F.transform("m.validation_status", lambda e: e["code"]), 1, 3), ",")
    return x.select(media, score.alias("score"), F.coalesce("a.claim_generator", F.lit("unknown")).alias("generator"), F.when(bad, codes).alias("codes"))
