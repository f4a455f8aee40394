"""Cover selection inside the row of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.sources.epub import cover_items, with_entry
from narrate_spark.sources.files import base_name, suffix_of


def is_image(name: Column, media_type: Column) -> Column:
    """Whether an item holds an image."""
    return F.startswith(media_type, F.lit("image/")) | suffix_of(name).isin(*K.IMAGE_SUFFIXES)


def image_suffix(name: Column) -> Column:
    """Suffix of the stored cover."""
    suffix = suffix_of(name)
    return F.when(suffix == "", ".jpg").otherwise(suffix)


def _usable(item: Column) -> Column:
    """Item with what the ranking needs: whether it is an image, and the image name that a page shows."""
    image = is_image(item["name"], item["media_type"])
    page = (
        suffix_of(item["name"]).isin(*K.HTML_SUFFIXES)
        | F.contains(F.lower(item["media_type"]), F.lit("html"))
        | F.contains(F.lower(F.coalesce(item["head"], F.lit(""))), F.lit("<html"))
    )
    shows = F.when(~image & page, F.nullif(F.lower(base_name(item["shows"])), F.lit("")))
    return F.struct(
        item["pos"].alias("pos"),
        item["item_id"].alias("item_id"),
        item["name"].alias("name"),
        item["entry"].alias("entry"),
        item["is_cover"].alias("is_cover"),
        image.alias("image"),
        shows.alias("shows"),
    )


def _ranks(item: Column) -> Column:
    lower_id = F.lower(F.coalesce(item["item_id"], F.lit("")))
    named = F.contains(lower_id, F.lit("cover")) | F.contains(F.lower(base_name(item["name"])), F.lit("cover"))
    return F.array_compact(
        F.array(
            F.when(item["is_cover"], 1),
            F.when(item["item_id"] == "cover", 3),
            F.when(named, 4),
            F.when(item["image"], 5),
        )
    )


def best_cover(found: Column) -> Column:
    """The cover of an archive as (rank, order, sub, name, entry), null when it has none.

    ``found`` is the result of ``epub.cover_items``.  Candidates are the item with the
    cover property, those that the metadata name, the one called ``cover``, those
    with such a name, and all images, in this order.  A page that wraps the cover
    stands for the first image whose name holds that of the image it shows;
    candidates without a usable image fall through to the next one.
    """

    def placed(rank: Column, order: Column, item: Column) -> Column:
        return F.struct(rank.cast("bigint").alias("rank"), order.cast("bigint").alias("order"), item.alias("item"))

    def chosen(source: Column, sub: Column, image: Column) -> Column:
        return F.struct(
            source["rank"].alias("rank"),
            source["order"].alias("order"),
            sub.cast("bigint").alias("sub"),
            image["name"].alias("name"),
            image["entry"].alias("entry"),
        )

    def rank(usable: Column) -> Column:
        by_item = F.flatten(
            F.transform(usable, lambda i: F.transform(_ranks(i), lambda r: placed(r, i["pos"], i)))
        )
        by_meta = F.flatten(
            F.transform(
                found["metas"],
                lambda m, at: F.transform(
                    F.filter(usable, lambda i: (i["item_id"] == m) & (m != "")), lambda i: placed(F.lit(2), at, i)
                ),
            )
        )
        images = F.filter(usable, lambda i: i["image"])

        def resolve(c: Column) -> Column:
            item = c["item"]
            shown = F.filter(images, lambda i: F.contains(F.lower(i["name"]), item["shows"]))
            return F.when(item["image"], F.array(chosen(c, F.lit(0), item))).otherwise(
                F.transform(shown, lambda i: chosen(c, i["pos"], i))
            )

        wanted = F.filter(F.concat(by_item, by_meta), lambda c: c["item"]["image"] | c["item"]["shows"].isNotNull())
        return F.array_min(F.flatten(F.transform(wanted, resolve)))

    usable = F.transform(F.filter(found["items"], lambda i: i["size"] > 0), _usable)
    return F.get(F.transform(F.array(usable), rank), F.lit(0))


def pick_cover(books: DataFrame, with_content: bool = False) -> DataFrame:
    """The cover image of every archive (book_id, content) that has one.

    Returns book_id, rank, name and suffix, and with ``with_content`` the image.  All is
    done in the archive's row: one scan, no exchange.
    """
    kept = ["book_id", "content"] if with_content else ["book_id"]
    items = books.select(*kept, cover_items(F.col("content")).alias("_items"))
    best = items.select(*kept, best_cover(F.col("_items")).alias("_best")).where(F.col("_best").isNotNull())
    found = best.select(
        "book_id",
        F.col("_best.rank").alias("rank"),
        F.col("_best.name").alias("name"),
        image_suffix(F.col("_best.name")).alias("suffix"),
        *([F.col("_best.entry").alias("entry"), "content"] if with_content else []),
    )
    return with_entry(found).drop("entry") if with_content else found
