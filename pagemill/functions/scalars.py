"""Helper functions rules may call, as Spark columns."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE


def base64_encode(c: Column) -> Column:
    return plain_base64(F.encode(c, "utf-8"))


def plain_base64(c: Column) -> Column:
    """Base64 in one line (Spark breaks it into lines of 76)."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))


def base64_decode(c: Column) -> Column:
    return F.decode(F.unbase64(c), "utf-8")


def base64_bytes(c: Column) -> Column:
    return F.unbase64(c)


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c, "utf-8")))


def hex_decode(c: Column) -> Column:
    return F.decode(F.unhex(F.regexp_replace(c, "[^0-9a-fA-F]", "")), "utf-8")


def str_to_bytes(c: Column) -> Column:
    return F.encode(c, "utf-8")


def bytes_to_str(c: Column) -> Column:
    return F.decode(c, "utf-8")


def encode_uri(c: Column) -> Column:
    """Component encoding of web scripts: blanks as %20, and ! ' ( ) * ~ as they are."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def md5_16(c: Column) -> Column:
    return F.substring(F.md5(c), 9, 16)


def digest_hex(c: Column, algorithm: str) -> Column:
    name = algorithm.upper().replace("-", "")
    if name == "MD5":
        return F.md5(c)
    if name == "SHA1":
        return F.sha1(c)
    return F.sha2(c, int(name.removeprefix("SHA")))


def digest_base64(c: Column, algorithm: str) -> Column:
    return plain_base64(F.unhex(digest_hex(c, algorithm)))


def hmac_hex(c: Column, key: str, algorithm: str) -> Column:
    """Keyed digest with a constant key: two plain digests over the padded key and the text."""
    name = algorithm.upper().replace("HMAC", "").replace("-", "")
    block = 128 if name in ("SHA384", "SHA512") else 64
    secret = key.encode()
    if len(secret) > block:
        secret = hashlib.new(name.lower(), secret).digest()
    secret = secret.ljust(block, b"\0")

    def padded(pad: int, rest: Column) -> Column:
        return digest_hex(F.concat(F.lit(bytes(x ^ pad for x in secret)), rest), name)

    return padded(0x5C, F.unhex(padded(0x36, F.encode(c, "utf-8"))))


def hmac_base64(c: Column, key: str, algorithm: str) -> Column:
    return plain_base64(F.unhex(hmac_hex(c, key, algorithm)))


def aes_encrypt_base64(c: Column, key: Column, mode: str = "CBC", iv: Column | None = None) -> Column:
    """Cipher bytes alone when ``iv`` is given (16 characters); else a random vector stands in front of CBC bytes."""
    data = F.encode(c, "utf-8")
    if iv is None or mode == "ECB":
        return plain_base64(F.aes_encrypt(data, key, F.lit(mode), F.lit("PKCS")))
    boxed = F.aes_encrypt(data, key, F.lit(mode), F.lit("PKCS"), F.encode(iv, "utf-8"))
    return plain_base64(F.substring(boxed, 17, 2**31 - 1))


def aes_decrypt_base64(c: Column, key: Column, mode: str = "CBC", iv: Column | None = None) -> Column:
    """The reverse: ``iv`` must be the one of the encryption, or absent if the vector is in front."""
    data = F.unbase64(c)
    if iv is not None and mode != "ECB":
        data = F.concat(F.encode(iv, "utf-8"), data)
    return F.decode(F.aes_decrypt(data, key, F.lit(mode), F.lit("PKCS")), "utf-8")


def time_format(ms: Column, pattern: str = "yyyy-MM-dd HH:mm", offset_hours: float = 8) -> Column:
    """Epoch milliseconds at a fixed offset (session time zone must be UTC); letters without a meaning stand as written."""
    pattern = re.sub(r"('[^']*')|([yMdHhmsSEa]+)|((?:(?![yMdHhmsSEa])[A-Za-z])+)", lambda m: f"'{m[3]}'" if m[3] else m[0], pattern)
    return F.date_format(F.timestamp_millis((ms + int(offset_hours * 3_600_000)).cast("bigint")), pattern)


def format_stamp(ms: Column) -> Column:
    return time_format(ms)


def format_stamp_compact(ms: Column) -> Column:
    return time_format(ms, "yyyyMMdd")


def string_list(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\n"))


def parse_int(c: Column) -> Column:
    return c.try_cast("int")


def to_hex_string(c: Column) -> Column:
    return F.lower(F.hex(c))


def csv_cell(c: Column) -> Column:
    v = F.coalesce(c, F.lit(""))
    return F.when(
        v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(v)


def markdown_cell(c: Column) -> Column:
    from .text import web_trim

    v = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    v = F.replace(v, F.lit("|"), F.lit("\\|"))
    return web_trim(F.regexp_replace(v, "\r\n|\r|\n", "<br>"))


def safe_file_name(c: Column) -> Column:
    bare = F.regexp_replace(c, r'[\x00-\x1f\x7f/\\:*?"<>|]', "")
    from .text import web_trim

    return web_trim(F.substring(F.regexp_replace(bare, f"{SPACE}+", " "), 1, 40))


# --- fixed values: file extension to media type ------------------------------------------------
MIME_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "avif": "image/avif", "bmp": "image/bmp", "svg": "image/svg+xml",
    "mp3": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/aac", "ogg": "audio/ogg",
    "wav": "audio/wav", "flac": "audio/flac", "mp4": "video/mp4",
    "txt": "text/plain; charset=utf-8", "epub": "application/epub+zip", "pdf": "application/pdf",
    "zip": "application/zip", "rar": "application/x-rar-compressed",
}
# -----------------------------------------------------------------------------------------------


def mime_type(url: Column) -> Column:
    """Media type by file extension, NULL when the extension is not in the table."""
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    last = F.regexp_extract(url, r"^[^?#]*/([^/?#]*)", 1)
    return F.try_element_at(table, F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1)))


def random_uuid() -> Column:
    """A version 4 identifier, another one in every row."""
    return F.uuid()


def sorted_values(values: Column) -> Column:
    """A list in the order of its texts; nulls last."""
    return F.array_sort(values)


def reversed_text(c: Column) -> Column:
    """The code points of a text from the last to the first."""
    return F.reverse(c)


def to_simplified(c: Column) -> Column:
    """As it is: the text helper of this name is documented as a pass-through."""
    return c


def to_traditional(c: Column) -> Column:
    """As it is, like ``to_simplified``."""
    return c
