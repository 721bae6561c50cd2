"""Image bytes, declared types and magic numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "ico": "image/x-icon", "heic": "image/heic", "heif": "image/heif", "avif": "image/avif"}


def _hex(data: Column, start: int, n: int) -> Column:
    return F.hex(F.substring(data, start, n))


def actual_mime(data: Column) -> Column:
    """By the first bytes; null where none fits."""
    return (
        F.when(_hex(data, 1, 8) == "89504E470D0A1A0A", "image/png")
        .when((_hex(data, 1, 4) == "52494646") & (_hex(data, 9, 4) == "57454250"), "image/webp")
        .when(_hex(data, 1, 6).isin("474946383761", "474946383961"), "image/gif")
        .when(_hex(data, 1, 2) == "424D", "image/bmp")
        .when(_hex(data, 1, 4).isin("49492A00", "4D4D002A"), "image/tiff")
        .when(_hex(data, 1, 3) == "FFD8FF", "image/jpeg")
    )


def mime_of_path(path: Column) -> Column:
    """By what follows the last dot, in any case; null where it is unknown."""
    ext = F.lower(F.regexp_extract(path, r"(?s)\.([^.]*)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]


def declared_mime(image: Column, kind: T.DataType) -> Column:
    """From a data URI's header, as it is written, or a struct's path."""
    if isinstance(kind, T.StructType):
        return mime_of_path(image["path"]) if "path" in kind.fieldNames() else F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        head = F.regexp_extract(F.substring_index(image, ",", 1), r"^data:([^;]*)", 1)
        return F.when(image.startswith("data:") & (head != ""), head)
    return F.lit(None).cast("string")


def _base64(c: Column) -> Column:
    """Strict base64; null where it isn't."""
    return F.try_to_binary(c, F.lit("base64"))


def image_bytes(image: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return image
    if isinstance(kind, T.StringType):
        return F.when(image.startswith("data:") & F.contains(image, F.lit(",")), _base64(F.regexp_replace(image, r"(?s)^[^,]*,", ""))).otherwise(_base64(image))
    if isinstance(kind, T.StructType) and "bytes" in kind.fieldNames():
        return image["bytes"] if isinstance(kind["bytes"].dataType, T.BinaryType) else _base64(image["bytes"])
    return F.lit(None).cast("binary")


def image_key(image: Column, kind: T.DataType) -> Column:
    """Identity of an image: md5 of its bytes, else its path, else its text; null where it is null."""
    if isinstance(kind, T.BinaryType):
        return F.md5(image)
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        parts = [F.md5(image["bytes"].cast("binary"))] if "bytes" in names else []
        parts += [image["path"]] if "path" in names else []
        return F.when(image.isNotNull(), F.coalesce(*parts, F.to_json(image)))
    return image.cast("string")


def sniffed_mime(name: Column, data: Column) -> Column:
    """For display: the name's extension first, then the bytes, JPEG where neither tells."""
    return F.coalesce(mime_of_path(name), actual_mime(data), F.lit("image/jpeg"))


def data_url(name: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), sniffed_mime(name, data), F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))
