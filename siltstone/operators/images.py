"""Image references in markdown and the images table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X

#: Images stored for one document at most.
PER_DOCUMENT = 60


def image_id(data: Column, ext: Column) -> Column:
    """Content address: 20 hex digits of the hash, and the extension (`.png` if unknown)."""
    return _named(F.sha2(data, 256), ext)


def _named(hash: Column, ext: Column) -> Column:
    return F.concat(F.left(hash, F.lit(20)), F.when(F.lower(ext).isin(*X.MIME_TYPES), F.lower(ext)).otherwise(".png"))


def dedup_images(images: DataFrame) -> DataFrame:
    """images (collection, doc_id, ext, bytes) with image_id, each image once for a document."""
    return images.withColumn("image_id", image_id(F.col("bytes"), F.col("ext"))).dropDuplicates(["collection", "doc_id", "image_id"])


def missing_descriptions(images: DataFrame, cache: DataFrame) -> DataFrame:
    """hash, bytes of the images that the cache (hash, version, text) doesn't describe, each once."""
    hashed = images.select(F.sha2("bytes", 256).alias("hash"), "bytes").dropDuplicates(["hash"])
    return hashed.join(cache.select("hash"), "hash", "left_anti")


def describe(missing: DataFrame, describer: Callable[[bytes], str | None], version: str) -> DataFrame:
    """hash, version, text of missing images (hash, bytes), by a describer such as a vision model; one that fails or has nothing to say gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = []
            for raw in rows.column(1).to_pylist():
                try:
                    texts.append(describer(raw) or "")
                except Exception:  # one image's failure leaves it for the next run
                    texts.append("")
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([version] * len(texts), pa.string()), pa.array(texts, pa.string())], ["hash", "version", "text"])

    return missing.select("hash", "bytes").mapInArrow(run, "hash string, version string, text string")


def merge_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache and what was found; empty texts aren't kept."""
    return cache.unionByName(found.where("length(text) > 0").join(cache.select("hash"), "hash", "left_anti"))


def drop_images(images: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """images without those whose keys (collection, or collection and doc_id) stand in gone."""
    return images.join(gone.select(*keys).distinct(), keys, "left_anti")


def resolve_relative(src: Column, base: Column, root: str) -> Column:
    """The path of a relative image below root, `..` resolved from base; null for other schemes, server paths, other files and paths that leave root."""
    parts = F.filter(F.concat(F.split(base, "/"), F.split(src, "/")), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    path = F.concat(F.lit("/"), F.array_join(walked, "/"))
    ext = F.lower(F.regexp_extract(src, r"(\.[^./\\]+)$", 1))
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return F.when(~F.startswith(src, F.lit("/")) & ~F.contains(F.element_at(F.split(src, "/"), 1), F.lit(":")) & ext.isin(*X.MIME_TYPES) & inside, path)


def resolve_by_priority(refs: DataFrame, files: DataFrame, folders: tuple[str, ...] = ("", "attachments/", "images/", "Data/")) -> DataFrame:
    """refs (base, ref) with the path of the first existing file of base + folder + ref, else of any file of that name (the least path), else null."""
    tries = F.posexplode(F.array(*[F.concat("base", F.lit("/" + f), "ref") for f in folders])).alias("priority", "path")
    first = refs.select("base", "ref", tries).join(files.select("path"), "path").groupBy("base", "ref").agg(F.min_by("path", "priority").alias("near"))
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    named = files.groupBy(name("path").alias("_name")).agg(F.min("path").alias("far"))
    out = refs.join(first, ["base", "ref"], "left").join(named, name(F.col("ref")) == F.col("_name"), "left")
    return out.select("base", "ref", F.coalesce("near", "far").alias("path"))


def rewrite_images(docs: DataFrame, files: DataFrame, fetched: DataFrame, descriptions: DataFrame, root: str = "/", most: int = PER_DOCUMENT) -> DataFrame:
    """doc_id, markdown of docs (collection, doc_id, base, markdown) with every `![alt](src)` rewritten.

    files (path, bytes), fetched (url, bytes, ext) and descriptions (hash, text) are looked up. An absolute URL stays
    unless it was fetched; a data URI or a file below root is stored as an image reference; what can't be read leaves its cleaned
    alternative text if that is longer than 3 characters. Stored images with a description get its block, decorative
    ones vanish. After `most` stored images of a document, later ones leave their text (URLs stay). Bytes are hashed where they are read; only hashes are joined.
    """
    refs = docs.select("collection", "doc_id", "base", F.posexplode(F.regexp_extract_all("markdown", F.lit(X.IMAGE_REF), 0)).alias("k", "whole"))
    refs = refs.select("*", F.regexp_extract("whole", X.IMAGE_REF, 1).alias("alt"), F.regexp_extract("whole", X.IMAGE_REF, 2).alias("src"))
    refs = refs.withColumns({"absolute": F.col("src").rlike("^https?://"), "data": X.decode_data_uri(F.col("src"))})
    data = F.when(F.col("data").isNotNull(), F.struct(F.sha2("data.bytes", 256).alias("hash"), F.col("data.ext").alias("ext")))
    refs = refs.select("collection", "doc_id", "k", "alt", "absolute", data.alias("data"), resolve_relative(F.col("src"), F.col("base"), root).alias("path"), F.when(F.col("absolute"), F.col("whole")).alias("whole"), F.when(F.col("absolute"), F.col("src")).alias("src"), F.lower(F.regexp_extract("src", r"(\.[^./]+)$", 1)).alias("end"))
    hashed = lambda *more: F.struct(F.sha2("bytes", 256).alias("hash"), F.length("bytes").alias("size"), *more)
    refs = refs.join(fetched.select(F.col("url").alias("src"), hashed("ext").alias("remote")), "src", "left").join(files.select("path", hashed().alias("local")), "path", "left")
    local = F.when(F.col("local.size").between(2000, 10 * 1024 * 1024), F.struct("local.hash", F.col("end").alias("ext")))
    remote = F.when(F.col("remote.size") >= 2000, F.struct("remote.hash", "remote.ext"))
    refs = refs.withColumn("image", F.when(F.col("absolute"), remote).otherwise(F.coalesce("data", local)))
    order = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    refs = refs.withColumns({"nth": F.sum(F.col("image").isNotNull().cast("int")).over(order), "hash": F.col("image.hash")})
    refs = refs.join(descriptions.select("hash", F.col("text").alias("description")), "hash", "left")
    link = F.concat(F.lit(X.IMAGE_SCHEME + "://"), F.col("collection"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), _named(F.col("hash"), F.col("image.ext")))
    alt = X.sanitize_alt(F.col("alt"))
    told = F.coalesce(F.length("description"), F.lit(0)) > 0
    block = F.when(told & X.is_decorative(F.col("description")), "").when(told, F.concat(F.lit("\n\n"), X.image_block(F.col("description"), link), F.lit("\n\n")))
    block = block.otherwise(F.concat(F.lit("!["), F.when(alt == "", "capture").otherwise(alt), F.lit("]("), link, F.lit(")")))
    stored = F.col("image").isNotNull() & (F.col("nth") <= most)
    text = F.when(stored, block).when(F.col("absolute"), F.col("whole")).when(F.col("image").isNotNull(), alt).otherwise(F.when(F.length(alt) > 3, alt).otherwise(""))
    by = refs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("r")).select("doc_id", F.col("r.t").alias("texts"))
    parts = F.split("markdown", X.IMAGE_REF)
    woven = F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.coalesce(F.get("texts", i - 1), F.lit(""))).otherwise(""), p)), "")
    return docs.join(by, "doc_id", "left").select("doc_id", F.when(F.col("texts").isNull(), F.col("markdown")).otherwise(woven).alias("markdown"))
