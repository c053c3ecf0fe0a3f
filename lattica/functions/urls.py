"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The size words of a photo's file name, and extensions of photos.
SIZES = ("square", "small", "medium", "large")
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp")


def resized(url: Column, size: str = "large", need_extension: bool = True) -> Column:
    """The size word of a URL's file name replaced and its query kept; null where the name is no known size with a dot and, unless need_extension is false, an extension. The unscaled `original` is refused."""
    tail = r"\.[^./?]+" if need_extension else r"\.[^./?]*"
    pattern = rf"(^|/)({'|'.join(SIZES)})({tail})(\?.*)?$"
    return F.when(url.rlike(pattern), F.regexp_replace(url, pattern, f"$1{size}$3$4"))


def large_url(url: Column, hosts: tuple[str, ...], size: str = "large") -> Column:
    """Strict form: https, an allowed host, a known size (or original), a photo's extension in any case or none behind the dot; query and fragment go. Null otherwise."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(?i:https)://", "https://")
    pattern = rf"/({'|'.join(SIZES)}|original)\.((?i:{'|'.join(EXTENSIONS)})?)$"
    ok = bare.startswith("https://") & F.lower(F.try_parse_url(bare, F.lit("HOST"))).isin(*hosts) & bare.rlike(pattern)
    return F.when(ok, F.regexp_replace(bare, pattern, f"/{size}.$2"))


def api_url(base: str, **query: Column) -> Column:
    """base?k=v&... with encoded values, in the order given."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in query.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")
