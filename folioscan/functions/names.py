"""Names and texts that the engine derives: image files, prompts, batches, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_name(source: Column, page: Column) -> Column:
    """Every '.pdf' goes, spaces become underscores, lower case, then the page, at least four digits wide."""
    stem = F.lower(F.replace(F.replace(source, F.lit(".pdf"), F.lit("")), F.lit(" "), F.lit("_")))
    return F.concat(stem, F.lit("__page_"), F.format_string("%04d", page), F.lit(".png"))


def image_path(folder: str, source: Column, page: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), image_name(source, page))


def writer_image_name(source: Column, page: Column) -> Column:
    """The older writers' name: the last suffix goes, nothing else changes."""
    return F.concat(F.regexp_replace(source, r"\.[^.]*$", ""), F.lit("__page_"), F.format_string("%04d", page), F.lit(".png"))


def notebook_image_name(source: Column, page: Column) -> Column:
    """The notebooks' name: every '.pdf' goes, nothing else changes."""
    return F.concat(F.replace(source, F.lit(".pdf"), F.lit("")), F.lit("__page_"), F.format_string("%04d", page), F.lit(".png"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def prompt(question: Column, n_images: Column, pages: Column) -> Column:
    """The request to a generator; pages lists the hits as 'source p. page'."""
    return F.concat(
        F.lit("You answer questions about document pages.\nQuestion: "), question, F.lit("\nPages attached: "), n_images.cast("string"), F.lit(" ("), pages,
        F.lit(")\nUse these pages only. Name the page behind each statement. If they do not hold the answer, say so. Be brief."),
    )


def batch_of(ordinal: Column, size: int) -> Column:
    if size < 1:
        raise ValueError("a batch holds one row at least")
    return F.floor(ordinal / F.lit(size)).cast("long")


def mebibytes(size: Column) -> Column:
    return size / F.lit(1024.0 * 1024.0)


def encode_hours(pages: Column, seconds_a_page: float) -> Column:
    return pages * F.lit(seconds_a_page) / F.lit(3600.0)


def shown(value: Column, digits: int) -> Column:
    """The double in fixed notation as C's printf gives it: its binary value is rounded, half to even, where Java's formatter rounds the shortest decimal of that value half up."""
    size = F.abs(value.cast("double"))
    coarse = size.cast("float").cast("double")  # 24 and 29 bits, so both products are exact
    high, low = coarse * 10**digits, (size - coarse) * 10**digits
    whole = F.floor(high + low)
    over = (high - whole - 0.5) + low
    units = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)
    text = F.format_string(f"%s%d.%0{digits}d", F.when(value.cast("string").startswith("-"), "-").otherwise(""), (units / 10**digits).cast("long"), units % 10**digits)
    return F.when(size < 1e9, text).otherwise(F.format_string(f"%.{digits}f", value))
