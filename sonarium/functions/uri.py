"""Audio references: normalise to ``s3://bucket/key`` and take them apart. Pure columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarium.functions.binding import bind

# ---- fixed values: shapes of a reference ---------------------------------------------------
QUERY = r"^[^?#]*\?([^#]*)"
FILE_URI_PARAM = r"(?:^|&)fileuri=([^&]+)"
STRICT_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
LAST_PARAMS = r";[^/]*$"
IDLE_SEGMENTS = r"/+(\./+)*(\.$)?"
# --------------------------------------------------------------------------------------------

# Plain string functions do the common work; regular expressions run only where a cheap test asks for them.


def _scheme(uri: Column) -> Column:
    return F.lower(F.substring_index(uri, "://", 1))


def _from_http(host: Column, path: Column) -> Column:
    """Virtual-hosted URLs carry the bucket in the host, others in the first path segment."""

    def locate(clean: Column) -> Column:
        two_labels = F.substring_index(host, ".", 2)
        virtual = (two_labels != host) & F.substring_index(two_labels, ".", -1).startswith("s3")
        key = F.when(path == "", F.lit(".")).otherwise(clean)  # an empty path reads as "."
        bucket = F.substring_index(host, ".", 1)
        return F.when(
            virtual, F.when((bucket != "") & (key != ""), F.concat(F.lit("s3://"), bucket, F.lit("/"), key))
        ).when(F.instr(clean, "/") > 0, F.concat(F.lit("s3://"), clean))

    # drop ";params" of the last segment, then empty segments, "." segments and outer slashes
    plain = F.when(path.contains(";"), F.regexp_replace(path, LAST_PARAMS, "")).otherwise(path)
    idle = plain.contains("//") | plain.contains("/./") | plain.endswith("/.")
    tidy = F.when(idle, F.regexp_replace(plain, IDLE_SEGMENTS, "/")).otherwise(plain)
    return bind(F.btrim(tidy, F.lit("/")), locate)


def _direct(uri: Column) -> Column:
    """The s3 and http(s) shapes; NULL for anything else."""

    def by_scheme(scheme: Column, host: Column, path: Column) -> Column:
        from_s3 = F.when((host != "") & (F.btrim(path, F.lit("/")) != ""), F.concat(F.lit("s3://"), host, path))
        return F.when(scheme == "s3", from_s3).when(scheme.isin("http", "https"), _from_http(host, path))

    def take_apart(address: Column) -> Column:
        rest = F.substr(address, F.instr(address, "://") + 3)
        host = F.substring_index(rest, "/", 1)
        return F.array(_scheme(address), host, F.substr(rest, F.length(host) + 1))

    address = F.substring_index(F.substring_index(uri, "#", 1), "?", 1)
    return bind(bind(address, take_apart), lambda parts: by_scheme(parts[0], parts[1], parts[2]))


def _file_uri(uri: Column) -> Column:
    """The ``fileuri`` parameter of a resolver path: plain or strictly base64-encoded."""

    def decode(value: Column) -> Column:
        decoded = F.try_validate_utf8(F.try_to_binary(value, F.lit("base64")).cast("string"))
        return F.when(value.startswith("s3://"), value).when((value != "") & value.rlike(STRICT_BASE64), decoded)

    raw = F.regexp_extract(F.regexp_extract(uri, QUERY, 1), FILE_URI_PARAM, 1)
    return bind(raw, lambda value: bind(F.coalesce(F.try_url_decode(value), value), decode))


def normalize_uri(uri: Column | str, mode: str = "fail") -> Column:
    """Canonical ``s3://bucket/key``. ``mode='null'`` gives NULL where ``'fail'`` raises.

    The second host label starting with ``s3`` marks a virtual-hosted URL; endpoints such as
    ``x.s3.lan/bucket/key`` are therefore read as bucket ``x``.
    """
    uri = F.col(uri) if isinstance(uri, str) else uri
    broken = uri.contains("\n") | uri.contains("\t") | uri.contains("\r")
    text = F.ltrim(F.when(broken, F.translate(uri, "\t\r\n", "")).otherwise(uri))
    result = bind(
        text,
        lambda t: bind(
            F.when(_scheme(t).isin("s3", "http", "https"), t).otherwise(_file_uri(t)), _direct
        ),
    )
    if mode == "null":
        return result
    problem = F.concat(F.lit("unrecognised audio reference: "), F.coalesce(uri, F.lit("NULL")))
    return F.coalesce(result, F.raise_error(problem).cast("string"))


def file_name(uri: Column | str) -> Column:
    """Last path component of a canonical reference."""
    uri = F.col(uri) if isinstance(uri, str) else uri
    return F.substring_index(F.rtrim(uri, F.lit("/")), "/", -1)


def split_uri(uri: Column | str, mode: str = "fail") -> Column:
    """``STRUCT<bucket, key>`` of a complete s3 reference."""
    uri = F.col(uri) if isinstance(uri, str) else uri

    def take_apart(canonical: Column) -> Column:
        bucket = F.substring_index(F.substring_index(canonical, "/", 3), "/", -1)
        key = F.ltrim(F.substr(canonical, F.length(bucket) + 6), F.lit("/"))
        return F.when(canonical.isNotNull(), F.struct(bucket.alias("bucket"), key.alias("key")))

    parts = bind(F.when(_scheme(uri) == "s3", _direct(uri)), take_apart)
    if mode == "null":
        return parts
    problem = F.concat(F.lit("not a complete s3 reference: "), F.coalesce(uri, F.lit("NULL")))
    return F.coalesce(parts, F.raise_error(problem).cast("struct<bucket:string,key:string>"))
