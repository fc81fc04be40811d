"""Kind, size and colour mode of images from their first bytes, evaluated by the JVM on a hex text of a bounded prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Bytes that are looked at, and segments (JPEG) or entries (TIFF) that are walked. A size beyond them is not found.
PREFIX, STEPS = 1 << 16, 64

# Colour types of PNG, components of JPEG, photometric values of TIFF.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
TIFF_MODES = {0: "L", 1: "L", 2: "RGB", 3: "P", 5: "CMYK", 6: "YCbCr"}
TIFF_WIDTH, TIFF_HEIGHT, TIFF_PHOTOMETRIC = 256, 257, 262


def _number(h: Column, at, size: int, little: bool | Column = False) -> Column:
    """An unsigned number of ``size`` bytes at byte ``at`` (from 0); null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    raw = F.substring(h, (2 * at + 1).cast("int"), F.lit(2 * size))
    turned = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
    order = F.when(little, turned).otherwise(raw) if isinstance(little, Column) else turned if little else raw
    return F.when(F.length(raw) == 2 * size, F.conv(order, 16, 10).cast("long"))


def _named(value: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value.cast("int"))


def _found(kind: str, width: Column, height: Column, mode: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), width.cast("long").alias("width"), height.cast("long").alias("height"), mode.alias("mode"))


def _jpeg(h: Column) -> Column:
    """Segments from byte 2 on, up to the frame header."""
    is_frame = lambda m: m.between(0xC0, 0xCF) & ~m.isin(0xC4, 0xC8, 0xCC)

    def step(at: Column, _: Column) -> Column:
        mark = _number(h, at + 1, 1)
        further = F.when(mark == 0xFF, at + 1).when(mark.between(0xD0, 0xD8) | (mark == 1), at + 2).otherwise(at + 2 + _number(h, at + 2, 2))  # fill bytes, marks without a length, segments
        return F.when((_number(h, at, 1) == 0xFF) & ~is_frame(mark) & ~mark.isin(0xD9, 0xDA), F.coalesce(further, F.lit(1 << 30).cast("long"))).otherwise(at)

    place = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(2).cast("long"), step)
    frame = lambda at: F.when((_number(h, at, 1) == 0xFF) & is_frame(_number(h, at + 1, 1)), _found("JPEG", _number(h, at + 7, 2), _number(h, at + 5, 2), _named(_number(h, at + 9, 1), JPEG_MODES)))
    return T.let(place, frame)


def _tiff(h: Column) -> Column:
    """The entries of the first directory."""
    little = F.startswith(h, F.lit("4949"))

    def directory(at: Column) -> Column:
        n = F.least(F.coalesce(_number(h, at, 2, little), F.lit(0)), F.lit(STEPS))
        entries = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda i: F.when(i < n, F.struct(_number(h, at + 2 + 12 * i, 2, little).alias("tag"), F.when(_number(h, at + 4 + 12 * i, 2, little) == 3, _number(h, at + 10 + 12 * i, 2, little)).otherwise(_number(h, at + 10 + 12 * i, 4, little)).alias("value"))))
        value = lambda e, tag: F.get(F.filter(e, lambda x: x["tag"] == tag), F.lit(0))["value"]
        return T.let(entries, lambda e: _found("TIFF", value(e, TIFF_WIDTH), value(e, TIFF_HEIGHT), _named(value(e, TIFF_PHOTOMETRIC), TIFF_MODES)))

    return T.let(_number(h, 4, 4, little), directory)


def _webp(h: Column) -> Column:
    """A simple, a lossless or an extended file."""
    bits = lambda at: _number(h, at, 4, True)
    kind = F.substring(h, 25, 8)
    low = lambda c: c.bitwiseAND(0x3FFF)
    return (
        F.when(kind == "56503820", _found("WEBP", low(_number(h, 26, 2, True)), low(_number(h, 28, 2, True)), F.lit("RGB")))
        .when(kind == "5650384C", _found("WEBP", low(bits(21)) + 1, low(F.shiftright(bits(21), 14)) + 1, F.when(F.shiftright(bits(21), 28).bitwiseAND(1) == 1, "RGBA").otherwise("RGB")))
        .when(kind == "56503858", _found("WEBP", _number(h, 24, 3, True) + 1, _number(h, 27, 3, True) + 1, F.when(_number(h, 20, 1).bitwiseAND(16) != 0, "RGBA").otherwise("RGB")))
    )


def image_header(content: Column) -> Column:
    """struct(kind, width, height, mode) of PNG, JPEG, GIF, BMP, TIFF and WEBP; null for what is none of these. Fields
    that the first 65536 bytes do not tell are null."""

    def of(h: Column) -> Column:
        is_ = lambda magic: F.startswith(h, F.lit(magic))
        size = lambda at: F.when(_number(h, at, 4, True) >= 1 << 31, (1 << 32) - _number(h, at, 4, True)).otherwise(_number(h, at, 4, True))
        depth = _number(h, 28, 2, True)
        return (
            F.when(is_("89504E470D0A1A0A"), _found("PNG", _number(h, 16, 4), _number(h, 20, 4), _named(_number(h, 25, 1), PNG_MODES)))
            .when(is_("FFD8FF"), F.coalesce(_jpeg(h), _found("JPEG", F.lit(None), F.lit(None), F.lit(None).cast("string"))))
            .when(is_("474946383961") | is_("474946383761"), _found("GIF", _number(h, 6, 2, True), _number(h, 8, 2, True), F.lit("P")))
            .when(is_("424D"), _found("BMP", size(18), size(22), F.when(depth == 32, "RGBA").when(depth >= 16, "RGB").when(depth.isNotNull(), "P")))
            .when(is_("49492A00") | is_("4D4D002A"), _tiff(h))
            .when(is_("52494646") & (F.substring(h, 17, 8) == "57454250"), F.coalesce(_webp(h), _found("WEBP", F.lit(None), F.lit(None), F.lit(None).cast("string"))))
        )

    return T.let(F.hex(F.substring(content, 1, PREFIX)), of)
