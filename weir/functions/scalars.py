"""Scalar functions over columns: tolerant casts, keyed hashes, tokens, times.

All are expressions of built-in functions, so they stay inside generated code.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that are trimmed: Unicode white space and the four separators before it. Fixed values.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Spellings of a missing value, after trimming and lower-casing. Fixed values.
MISSING = ("", "-", "nan", "none", "null", "unknown")
#: Spellings of true. Fixed values.
TRUE = ("1", "true", "t", "yes", "y", "established")
#: TLS version names and their ids. Fixed values.
TLS_VERSIONS = {"SSLv3": 1, "TLSv10": 2, "TLSv11": 3, "TLSv12": 4, "TLSv13": 5}


def strip(c: Column) -> Column:
    """Text without blanks of any kind at either end."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` reads it, also for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(*MISSING)


def to_long63(hex_digest: Column) -> Column:
    """The first 8 bytes of a hex digest, big-endian, without the sign bit."""
    part = lambda at: F.conv(F.substring(hex_digest, at, 8), 16, 10).cast("long")
    return part(1).bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(1 << 32) + part(9)


def hmac_sha256(c: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of a string column; as the standard has it, a key of over 64 bytes is hashed first."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    inner, outer = (bytes(b ^ p for b in raw.ljust(64, b"\0")) for p in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def keyed_hash64(c: Column, key: str) -> Column:
    """A keyed 63-bit hash of trimmed text; 0 for a missing value."""
    c = c.cast("string")
    return F.when(is_missing(c), F.lit(0).cast("long")).otherwise(to_long63(hmac_sha256(strip(c), key)))


def number(c: Column) -> Column:
    """A double of text that is a decimal number (digits may be parted by single underscores); else null. Java's suffixes and hexadecimals are no numbers."""
    text = F.regexp_replace(strip(c), r"(?<=\d)_(?=\d)", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def float_or_zero(c: Column) -> Column:
    """A finite double; 0 for null, blank, NaN, infinite or unparsable."""
    x = number(c)
    return F.when(x.isNull() | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)


def int_or_zero(c: Column) -> Column:
    """The whole part of a finite number as long; else 0."""
    return float_or_zero(c).cast("long")


def bool_id(c: Column) -> Column:
    """1 for a spelling of true, else 0."""
    return F.when(F.lower(strip(c)).isin(*TRUE), 1).otherwise(0).cast("int")


def is_one(c: Column) -> Column:
    return F.coalesce(strip(c).isin("1", "1.0", "true", "True", "TRUE"), F.lit(False))


def first_present(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(strip(c) != "", c.cast("string")) for c in columns])


def _bare(c: Column) -> Column:
    """Trimmed text without brackets at its ends."""
    return F.regexp_replace(strip(c), r"^[\[\]()]+|[\[\]()]+$", "")


def _listed(c: Column) -> Column:
    """Is a text list present?"""
    return F.coalesce(~F.lower(strip(c)).isin("", "nan", "none", "null", "[]"), F.lit(False))


def _barred(c: Column) -> Column:
    """Items of a list that is parted by bars."""
    return F.filter(F.split(_bare(c), r"\|"), lambda x: x != "")


def parse_sequence(c: Column) -> Column:
    """Numbers of a text list, unparsable ones as 0; none for a missing value.

    Brackets are stripped. A text with bars is parted by bars alone; any other by blanks, commas and semicolons, and its items may be quoted.
    """
    loose = F.filter(F.split(_bare(c), r"[\s,;]+"), lambda x: x != "")
    loose = F.transform(loose, lambda x: F.regexp_replace(x, "^(['\"])(.*)\\1$", "$2"))
    parts = F.when(c.contains("|"), _barred(c)).otherwise(loose)
    return F.when(_listed(c), F.transform(parts, float_or_zero)).otherwise(F.array().cast("array<double>"))


def string_entropy(c: Column) -> Column:
    """Shannon bits over the characters of a text; 0 for an empty one."""

    def bits(chars: Column) -> Column:
        # characters in order: a run's length is what its end adds to -k log2 k
        n = F.size(chars).cast("double")
        start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("s"))
        more = lambda a: a["s"] + F.when(a["k"] > 0, a["k"] * F.log2(a["k"])).otherwise(0.0)
        step = lambda a, x: F.when(x == a["c"], F.struct(x.alias("c"), (a["k"] + 1.0).alias("k"), a["s"].alias("s"))).otherwise(F.struct(x.alias("c"), F.lit(1.0).alias("k"), more(a).alias("s")))
        return F.when(n > 0, F.log2(n) - F.aggregate(chars, start, step, more) / n).otherwise(0.0)

    return let(F.array_sort(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")), bits)


def last_label(c: Column) -> Column:
    """The last dotted label of a host name in lower case; blank without a dot."""
    host = F.lower(F.btrim(strip(F.coalesce(c, F.lit(""))), F.lit(".")))
    return F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1)).otherwise("")


def label_count(c: Column) -> Column:
    """Non-empty dotted labels of a host name."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\."), lambda x: x != "")).cast("int")


def tls_version_id(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TLS_VERSIONS.items() for x in kv]), c), F.lit(0)).cast("int")


def parse_vector(c: Column) -> Column:
    """Items of a log's vector field, parted by commas and blanks; none for ``-`` and ``(empty)``."""
    text = strip(F.coalesce(c, F.lit("")))
    items = F.filter(F.split(text, r"[,\s]+"), lambda x: (x != "") & (x != "-"))
    return F.when(text.isin("-", "(empty)", ""), F.array().cast("array<string>")).otherwise(items)


def epoch_seconds(c: Column) -> Column:
    """Epoch seconds of a timestamp column, to the microsecond."""
    return F.unix_micros(c.cast("timestamp")) / 1e6


def _iso_seconds(c: Column) -> Column:
    """Epoch seconds of an ISO date or time, in UTC where it names no zone; else null."""
    text = F.regexp_replace(strip(c), "Z", "+00:00")
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}.\d{2}.*[+-]\d{2}(:?\d{2}){0,2}$")
    whole = F.when(day, F.concat(text, F.lit("T00:00:00+00:00"))).when(zoned, text).otherwise(F.concat(text, F.lit("+00:00")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$"), F.unix_micros(whole.try_cast("timestamp")) / 1e6)


def timestamp_or_zero(c: Column) -> Column:
    """Epoch seconds of a number or an ISO time (no zone means UTC); else 0."""
    x = float_or_zero(c)
    return F.when(x != 0, x).otherwise(F.coalesce(_iso_seconds(c), F.lit(0.0)))


def time_sequence(c: Column) -> Column:
    """Epoch seconds of the items of a barred text list, as ``timestamp_or_zero``; none for a missing value."""
    return F.when(_listed(c), F.transform(_barred(c), timestamp_or_zero)).otherwise(F.array().cast("array<double>"))


def seconds_of_day(c: Column) -> Column:
    """Seconds since midnight of a text that starts with a clock, or has one right after its first T: two digits for each of hours, minutes and seconds at its places 1, 4 and 7, then a fraction. Any other text counts as ``timestamp_or_zero``."""
    text = strip(c)
    clock = F.when(text.contains("T"), F.regexp_replace(text, r"(?s)^[^T]*T", "")).otherwise(text)
    two = lambda at: F.when(F.substring(clock, at, 2).rlike(r"^(\d\d|[ +-]\d|\d )$"), strip(F.substring(clock, at, 2)).try_cast("double"))
    fraction = F.regexp_extract(clock, r"(?s)^.{8}\.(\d+)", 1)
    value = two(1) * 3600 + two(4) * 60 + two(7) + F.when(fraction != "", F.concat(F.lit("0."), fraction).try_cast("double")).otherwise(0.0)
    return F.coalesce(value, timestamp_or_zero(text))


def gaps_of_day(times: Column, n: Column) -> Column:
    """``n`` gaps between clock times of an array of texts: 0 first, a day added where the clock wraps, padded with 0 or cut."""
    gap = lambda a, b: F.greatest(b - a + F.when(b < a, 86400.0).otherwise(0.0), F.lit(0.0))
    gaps = lambda s: F.concat(F.slice(F.array(F.lit(0.0)), F.lit(1), F.least(F.size(s), F.lit(1))), F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), gap))
    found = let(F.transform(times, seconds_of_day), gaps)
    n = F.greatest(n, F.lit(0))
    return F.slice(F.concat(F.coalesce(found, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), F.lit(1), n)


def gap_sequence(c: Column, n: Column) -> Column:
    """``gaps_of_day`` of a barred text list; all 0 for a missing value."""
    return gaps_of_day(F.when(_listed(c), _barred(c)).otherwise(F.array().cast("array<string>")), n)


def signed_lengths(lengths: Column, directions: Column | None = None) -> Column:
    """Lengths with the sign of their direction, cut to the shorter array; without directions all count forward."""
    if directions is None:
        return lengths
    both = F.slice(F.arrays_zip(lengths.alias("n"), directions.alias("d")), F.lit(1), F.least(F.size(lengths), F.size(directions)))
    return F.transform(both, lambda x: F.when(x["d"] >= 0, x["n"]).otherwise(-x["n"]))


#: Parts of a row's identity, in order; the two times are written with six decimals. Fixed values.
IDENTITY = ("schema_version", "source", "source_file", "source_record_id", "proto", "src_ip_hash64", "dst_ip_hash64", "src_port", "dst_port", "time_first", "time_last", "label")
SCHEMA_VERSION = "mining_dataset_v1"


def row_id(columns: dict[str, Column]) -> Column:
    """The id of a row by the twelve parts of its identity; one that is not among ``columns`` is blank, or the version or time 0 that stands for it."""
    none = {"schema_version": F.lit(SCHEMA_VERSION)}
    parts = []
    for name in IDENTITY:
        c = columns.get(name, none.get(name, F.lit("")))
        parts.append(six_decimals(float_or_zero(c)) if name.startswith("time_") else c)
    return sample_id(*parts)


def sample_id(*parts: Column) -> Column:
    """SHA-256 of parts joined by bars; a null part is blank."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stem(path: Column) -> Column:
    """A file's name without its folders and its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def now_iso() -> Column:
    """The time in UTC as ISO text, to the second."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def six_decimals(c: Column) -> Column:
    return F.format_string("%.6f", F.coalesce(c, F.lit(0.0)))


def endpoint_key(ip_a: Column, port_a: Column, ip_b: Column, port_b: Column, proto: Column) -> Column:
    """Direction-free flow key text: endpoints in order of (address text, port)."""
    left = (ip_a < ip_b) | ((ip_a == ip_b) & (port_a <= port_b))
    a, b = (F.concat(ip, F.lit(":"), port.cast("string")) for ip, port in ((ip_a, port_a), (ip_b, port_b)))
    proto = F.lower(F.coalesce(F.when(proto != "", proto), F.lit("tcp")))
    return F.when(left, F.concat_ws("-", a, b, proto)).otherwise(F.concat_ws("-", b, a, proto))


def split_bucket(digest: Column, shares: tuple[float, float] = (0.70, 0.85)) -> Column:
    """train, validation or test by the first 12 hex digits of a digest as a share of their range."""
    x = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)
    return F.when(x < shares[0], "train").when(x < shares[1], "validation").otherwise("test")


def file_group_id(source: Column, file: Column) -> Column:
    """16 hex digits of SHA-256 over source, a zero byte and file."""
    raw = F.concat(F.encode(F.coalesce(source, F.lit("")), "UTF-8"), F.lit(b"\0"), F.encode(F.coalesce(file, F.lit("")), "UTF-8"))
    return F.substring(F.sha2(raw, 256), 1, 16)


def fingerprint(named: dict[str, Column]) -> Column:
    """SHA-256 of ``name=value`` parts joined by 0x1f; a null value is blank."""
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(n + "="), F.coalesce(c.cast("string"), F.lit(""))) for n, c in named.items()]), 256)


def certificate_facts(not_before: Column, not_after: Column, subject: Column, issuer: Column, names: Column, chain: Column | None = None, key_length: Column | None = None, key: str | None = None) -> dict[str, Column]:
    """Facts of a certificate: validity in days (0 unless both ends are there), alternative names, self-signing; with ``chain`` its length, with ``key_length`` that as a number, and with a ``key`` hashes of the two names."""
    there = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    days = F.greatest((timestamp_or_zero(not_after) - timestamp_or_zero(not_before)) / 86400, F.lit(0.0))
    out = {
        "validity_days": F.when(there(not_before) & there(not_after), days).otherwise(0.0),
        "san_count": F.size(parse_vector(names)).cast("int"),
        "self_signed": F.when(there(subject) & there(issuer) & (subject == issuer), 1).otherwise(0).cast("int"),
    }
    if chain is not None:
        out["chain_len"] = F.size(parse_vector(chain)).cast("int")
    if key_length is not None:
        out["key_length"] = int_or_zero(key_length)
    if key is not None:
        out |= {"subject_hash64": keyed_hash64(subject, key), "issuer_hash64": keyed_hash64(issuer, key)}
    return out


def possible_tls_port(port: Column, has_tls: Column, ports: tuple[int, ...] = (443, 8443, 9443)) -> Column:
    return F.when(port.isin(*ports) & (has_tls == 0), 1).otherwise(0).cast("int")
