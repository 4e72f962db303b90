"""Readers of project files: descriptor, snapshot, bundle, tables of contacts, HTML documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versotext.functions.js import canonical_json
from versotext.functions.text import glob_regex
from versotext.schema import CHANGESETS, KEY_DEFS, PAGE_DEFS, TEMPLATE_DEFS, VERSIONS, Descriptor

KEY_NAME = "^[a-z0-9]+(?:[._]+[a-z0-9]+)*$"
KEY_FIELDS = "shape string, target string, limits struct<max:int,severity:string>, budget struct<desktop:int,mobile:int>, values array<string>, vars array<string>, requires array<string>, tags int, derivesFrom string, tmpl string, pages array<string>, label string"
SEO_FIELDS = "title string, description string, robots string, canonical string, ogImage string, ogImageAlt string"


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file's text (path, text), a byte-order mark dropped."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\\ufeff", "").alias("text"))


def descriptor(spark: SparkSession, path: str) -> Descriptor:
    """Key, page and template tables of a descriptor file."""
    return parse_descriptor(whole_text(spark, path))


def parse_descriptor(texts: DataFrame) -> Descriptor:
    schema = f"keys map<string,struct<{_fields(KEY_FIELDS)}>>, pages map<string,struct<route:string,parent:string,locales:array<string>,seo:struct<{_fields(SEO_FIELDS)}>,jsonLd:struct<type:string,bindings:map<string,string>>>>, templates map<string,struct<class:string,trigger:string,slots:array<string>,wrapperProvides:array<string>>>"
    root = texts.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("d"))
    keys = root.select(F.explode("d.keys").alias("key", "v")).select("key", "v.*").withColumnRenamed("derivesFrom", "derives_from")
    pages = root.select(F.explode("d.pages").alias("page", "v")).select(
        "page", "v.route", "v.parent", "v.locales",
        F.when(F.col("v.seo").isNotNull(), F.struct("v.seo.title", "v.seo.description", "v.seo.robots", "v.seo.canonical", F.col("v.seo.ogImage").alias("og_image"), F.col("v.seo.ogImageAlt").alias("og_image_alt"))).alias("seo"), F.col("v.jsonLd").alias("json_ld"),
    )
    templates = root.select(F.explode("d.templates").alias("template", "v")).select("template", "v.class", "v.trigger", "v.slots", F.col("v.wrapperProvides").alias("wrapper_provides"))
    return Descriptor(*(_as(rows, s) for rows, s in ((keys, KEY_DEFS), (pages, PAGE_DEFS), (templates, TEMPLATE_DEFS))))


def _fields(ddl: str) -> str:
    return ", ".join(f"`{x.split()[0]}`:{' '.join(x.split()[1:])}" for x in _split(ddl))


def _split(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def _as(rows: DataFrame, ddl: str) -> DataFrame:
    schema = T._parse_datatype_string(ddl)
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def descriptor_faults(d: Descriptor) -> DataFrame:
    """``kind, holder, detail`` of declarations that can't hold: key names, missing shapes, enums without values."""
    shapes = ("text", "richtext", "media", "list", "record", "enum", "number", "color")
    fault = F.when(~F.col("key").rlike(KEY_NAME), "name").when(F.col("shape").isNull() | ~F.col("shape").isin(*shapes), "shape").when(F.col("target").isNull(), "target").when((F.col("shape") == "enum") & (F.coalesce(F.size("values"), F.lit(0)) < 1), "values").when(F.col("derives_from").isNotNull() & F.col("tmpl").isNull(), "tmpl")
    return d.keys.select(F.lit("key").alias("kind"), F.col("key").alias("holder"), fault.alias("detail")).where("detail is not null")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``locale, key, value_json`` of a committed snapshot; a file without a default locale fails."""
    return parse_snapshot(whole_text(spark, path))


def parse_snapshot(texts: DataFrame, column: str = "text") -> DataFrame:
    values = F.try_variant_get(F.try_parse_json(column), "$", "map<string,map<string,variant>>")
    checked = F.when(F.map_contains_key(values, "default"), values).otherwise(F.raise_error(F.lit("a snapshot must be a map of locales with a default")).cast("map<string,map<string,variant>>"))
    return texts.select(F.explode(checked).alias("locale", "v")).select("locale", F.explode("v").alias("key", "x")).select("locale", "key", canonical_json(F.coalesce(F.to_json("x"), F.lit("null"))).alias("value_json"))


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """``locale, key, value_json, version`` of a bundle, in the full form ({values, meta}) or bare."""
    texts = whole_text(spark, path)
    root = F.try_parse_json("text")
    texts = texts.select(F.coalesce(F.to_json(F.try_variant_get(root, "$.values", "variant")), F.col("text")).alias("text"), F.to_json(F.try_variant_get(root, "$.meta.version", "variant")).alias("versions"))
    numbers = texts.select(F.explode(F.from_json("versions", "map<string,map<string,long>>")).alias("locale", "m")).select("locale", F.explode("m").alias("key", "version"))
    return parse_snapshot(texts).join(numbers, ["locale", "key"], "left")


def contacts_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with quotes doubled inside quotes, any line ends and a header; short rows are padded with empty texts."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=True, mode="PERMISSIVE")
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).na.fill("")


def contacts_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects with text fields."""
    return spark.read.json(path, multiLine=True, primitivesAsString=True).na.fill("")


def documents(spark: SparkSession, folder: str, pattern: str = "**/*.html") -> DataFrame:
    """``path, text`` of the files below a folder that fit a glob (``**/``, ``**``, ``*``)."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern.rsplit("/", 1)[-1]).text(folder, wholetext=True)
    relative = F.regexp_replace(F.input_file_name(), "^.*?" + folder.rstrip("/") + "/", "")
    return rows.select(relative.alias("path"), F.col("value").alias("text")).where(F.col("path").rlike(glob_regex(pattern)))


def stored(spark: SparkSession, url: str, table: str = "content_versions", **options: str) -> DataFrame:
    """The version table of a relational store, read through JDBC; filters are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def empty_store(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The store of a project that has none: no versions, no changes."""
    return spark.createDataFrame([], VERSIONS), spark.createDataFrame([], CHANGESETS)
