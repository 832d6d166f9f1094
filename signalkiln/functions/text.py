"""Text protocols: session descriptions, request/response messages, headers, addresses. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _num(c: Column, kind: str = "bigint") -> Column:
    return c.try_cast(kind)


def _match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


# --- session descriptions -------------------------------------------------------------------------


def sdp_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, section, type, value, parts): section 0 is the session, each m= line begins another."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), r"\r\n|\n|\r", -1)).alias("line_no", "line")).where(F.col("line").rlike("^[a-z]="))
    w = W.partitionBy("doc_id").orderBy("line_no")
    kind, value = F.substring("line", 1, 1), F.btrim(F.substring("line", 3, 1 << 30))
    return lines.select("doc_id", "line_no", F.sum(F.when(kind == "m", 1).otherwise(0)).over(w).cast("int").alias("section"), kind.alias("type"), value.alias("value"), F.split(value, " +", -1).alias("parts"))


def typed_time(text: Column) -> Column:
    """Seconds of tokens such as `7d 1h 30m 5`: suffixes d, h, m, s; none means seconds."""
    unit = lambda t: F.when(t.endswith("d"), 86400).when(t.endswith("h"), 3600).when(t.endswith("m"), 60).otherwise(1)
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(-?\d+[dhms]?)"), 1), F.lit(0).cast("bigint"), lambda a, t: a + F.regexp_extract(t, r"-?\d+", 0).cast("bigint") * unit(t))


def _npt(text: Column) -> Column:
    """Seconds of `12.5`, `1:02:03.5` or `now`."""
    parts = F.split(text, ":")
    clock = F.when(F.size(parts) == 3, _num(parts[0], "double") * 3600 + _num(F.get(parts, F.lit(1)), "double") * 60 + _num(F.get(parts, F.lit(2)), "double"))
    return F.when(text == "now", F.lit(0.0)).when(F.size(parts) == 1, _num(text, "double")).otherwise(clock)


def sdp_range(text: Column) -> Column:
    """struct<type, start, end> of `npt=0-10`, `clock=...-...` or `smpte=...`; npt bounds in seconds, an open end is null."""
    kind = F.lower(_match(text, r"^\s*(npt|clock|smpte[^=]*)\s*=", 1))
    first, last = F.btrim(F.regexp_extract(text, r"=\s*([^-]*)-?(.*)$", 1)), F.btrim(F.regexp_extract(text, r"=\s*([^-]*)-?(.*)$", 2))
    clock = lambda c: F.unix_micros(F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))) / 1e6
    smpte = lambda c: F.aggregate(F.slice(F.split(c, ":"), 1, 3), F.lit(0.0), lambda a, x: a * 60 + _num(x, "double"))
    value = lambda c: F.when(c == "", None).when(kind == "npt", _npt(c)).when(kind == "clock", clock(c)).otherwise(smpte(c))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), value(first).alias("start"), value(last).alias("end")))


def sdp_bandwidth(value: Column) -> Column:
    return F.struct(F.split_part(value, F.lit(":"), F.lit(1)).alias("token"), _num(F.split_part(value, F.lit(":"), F.lit(2))).alias("value"))


def sdp_rtpmap(value: Column) -> Column:
    """struct<payload_type, encoding, rate, channels> of `96 H264/90000` or `97 L16/8000/2`."""
    p = r"^\s*(?:rtpmap:)?(\d+)\s+([^/\s]+)/(\d+)(?:/(\d+))?"
    return F.when(value.rlike(p), F.struct(_num(F.regexp_extract(value, p, 1), "int").alias("payload_type"), F.regexp_extract(value, p, 2).alias("encoding"), _num(F.regexp_extract(value, p, 3)).alias("rate"), F.coalesce(_num(_match(value, p, 4), "int"), F.lit(1)).alias("channels")))


def sdp_fmtp(value: Column) -> Column:
    """map of `96 k=v; k=v`; the last of repeated keys counts."""
    body = F.regexp_replace(value, r"^\s*(?:fmtp:)?\d+\s+", "")
    return params(body)


def sdp_control_uri(base: Column, control: Column) -> Column:
    """An absolute control URI stays, `*` or nothing is the base, anything else is appended to it."""
    slash = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    return F.when(control.isNull() | control.isin("", "*"), base).when(control.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), control).otherwise(F.concat(slash, F.ltrim(control, F.lit("/"))))


# --- messages and headers -------------------------------------------------------------------------


def params(text: Column, between: str = ";", sign: str = "=") -> Column:
    """map of `k=v` tokens, white space trimmed; a token without the sign has a null value, the last of equal keys counts."""
    tokens = F.filter(F.transform(F.split(text, between, -1), lambda t: F.btrim(t)), lambda t: t != "")
    key = lambda t: F.btrim(F.substring_index(t, sign, 1))
    pair = lambda t: F.struct(key(t), F.when(F.contains(t, F.lit(sign)), F.btrim(F.substring(t, F.instr(t, sign) + F.lit(1), F.length(t)))))
    last = F.filter(tokens, lambda t, i: ~F.exists(F.slice(tokens, i + 2, F.size(tokens)), lambda u: key(u) == key(t)))
    return F.map_from_entries(F.transform(last, pair))


def message(raw: Column) -> Column:
    """struct of an HTTP, RTSP or SIP message; a first line that begins with the protocol makes it a response."""
    # the first empty line, whatever its line ends; the body keeps its own
    place = {x: F.nullif(F.instr(raw, x), F.lit(0)) for x in ("\r\n\r\n", "\n\r\n", "\n\n", "\r\r")}
    at = F.least(*place.values())
    size = F.when(at == place["\r\n\r\n"], 4).when(at == place["\n\r\n"], 3).otherwise(2)
    head = F.regexp_replace(F.coalesce(F.left(raw, at - 1), raw), r"\r\n?", "\n")
    body = F.substring(raw, at + size, F.length(raw))
    first = F.substring_index(head, "\n", 1)
    response, request = r"^(HTTP|RTSP|SIP)/(\d+\.\d+)\s+(\d{3})\s*(.*)$", r"^([A-Z_]+)\s+(\S+)\s+(HTTP|RTSP|SIP)/(\d+\.\d+)\s*$"
    is_request = first.rlike(request)
    pick = lambda a, b: F.when(is_request, _match(first, request, a)).otherwise(_match(first, response, b))
    every = F.split(F.regexp_replace(head, r"\n[ \t]+", " "), "\n", -1)
    lines = F.slice(every, F.lit(2), F.size(every))
    named = F.filter(lines, lambda x: F.contains(x, F.lit(":")))
    name = lambda x: F.lower(F.btrim(F.substring_index(x, ":", 1)))
    value = lambda x: F.btrim(F.substring(x, F.instr(x, ":") + F.lit(1), F.length(x)))
    names = F.array_distinct(F.transform(named, name))
    headers = F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(named, lambda x: name(x) == n), value), ",")))
    return F.struct(
        is_request.alias("is_request"), pick(3, 1).alias("protocol"), _num(pick(4, 2), "double").alias("version"),
        F.when(is_request, _match(first, request, 1)).alias("method"), F.when(is_request, _match(first, request, 2)).alias("uri"),
        F.when(~is_request, _num(_match(first, response, 3), "int")).alias("status"), F.when(~is_request, _match(first, response, 4)).alias("reason"),
        headers.alias("headers"), body.alias("body"), (is_request | first.rlike(response)).alias("valid"),
    )


def header(headers: Column, name: str) -> Column:
    """Case-insensitive look-up in the map that ``message`` gives."""
    return F.try_element_at(headers, F.lit(name.lower()))


def header_lines(headers: Column, empty_line: bool = True) -> Column:
    """`Name: value` lines in order of names, ended by an empty line."""
    pairs = F.array_sort(F.map_entries(headers))
    return F.concat(F.array_join(F.transform(pairs, lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("-"), F.lit(" "))), F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\r\n"))), ""), F.lit("\r\n" if empty_line else ""))


def range_header(start: Column, end: Column, unit: str = "bytes", time: Column | None = None) -> Column:
    out = F.concat(F.lit(unit + "="), F.coalesce(start.cast("string"), F.lit("")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("")))
    return out if time is None else F.concat(out, F.coalesce(F.concat(F.lit(";time="), time), F.lit("")))


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.encode(F.concat_ws(":", user, password), "UTF-8")))


def digest_response(user: Column, realm: Column, password: Column, method: Column, uri: Column, nonce: Column) -> Column:
    """RFC 2617 response without qop."""
    ha1, ha2 = F.md5(F.concat_ws(":", user, realm, password)), F.md5(F.concat_ws(":", method, uri))
    return F.md5(F.concat_ws(":", ha1, nonce, ha2))


def transport(value: Column) -> Column:
    """struct of a Transport header; an ssrc is read as decimal, else as hexadecimal."""
    get = lambda k: _match(value, rf"(?i)(?:^|;)\s*{k}\s*=\s*\"?([^;\"]*)")
    port = lambda k, i: _num(F.split_part(get(k), F.lit("-"), F.lit(i)), "int")
    pair = lambda k, a: F.struct(port(k, 1).alias("low"), F.coalesce(port(k, 2), port(k, 1)).alias("high")).alias(a)
    ssrc = get("ssrc")
    return F.struct(
        F.upper(F.btrim(F.substring_index(value, ";", 1))).alias("profile"), (~value.rlike("(?i)(^|;)\\s*multicast")).alias("unicast"), get("mode").alias("mode"), get("source").alias("source"), get("destination").alias("destination"),
        _num(get("ttl"), "int").alias("ttl"), F.coalesce(_num(ssrc), _num(F.conv(F.when(ssrc.rlike("^[0-9A-Fa-f]+$"), ssrc), 16, 10))).alias("ssrc"),
        pair("client_port", "client_port"), pair("server_port", "server_port"), pair("port", "port"), pair("interleaved", "interleaved"),
    )


def rtp_info(value: Column) -> Column:
    """array of struct<url, seq, rtptime, ssrc>, one for each comma-separated stream."""

    def one(x: Column) -> Column:
        p = params(x)
        get = lambda k: F.try_element_at(p, F.lit(k))
        return F.struct(get("url").alias("url"), _num(get("seq"), "int").alias("seq"), _num(get("rtptime")).alias("rtptime"), _num(get("ssrc")).alias("ssrc"))

    return F.transform(F.split(value, ",(?=\\s*url)"), one)


def timestamp_header(value: Column) -> Column:
    """struct<timestamp, delay> of `12.5 delay=0.25` or `12.5 0.25`."""
    return F.struct(_num(_match(value, r"^\s*([\d.]+)"), "double").alias("timestamp"), _num(_match(value, r"^\s*[\d.]+\s*;?\s*(?:delay=)?([\d.]+)"), "double").alias("delay"))


# --- strings and addresses ------------------------------------------------------------------------


def hex_to_bytes(text: Column) -> Column:
    """Bytes of the hexadecimal digits; other characters are left out, an odd last digit too."""
    clean = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.left(clean, (F.length(clean) - F.pmod(F.length(clean), F.lit(2))).cast("int")))


def substring_after(text: Column, pattern: str) -> Column:
    """What follows the first occurrence; '' without one."""
    at = F.instr(text, pattern)
    return F.when(at > 0, F.substring(text, at + F.lit(len(pattern)), F.length(text))).otherwise("")


def split_trim(text: Column, between: str, keep_empty: bool = False) -> Column:
    parts = F.transform(F.split(text, between, -1), lambda t: F.btrim(t))
    return parts if keep_empty else F.filter(parts, lambda t: t != "")


def read_until(b: Column, delimiter: str, charset: str = "UTF-8") -> Column:
    return F.substring_index(F.decode(b, charset), delimiter, 1)


def ipv4(text: Column) -> Column:
    """The address as a bigint; null for anything that isn't four numbers up to 255."""
    p = F.split(text, r"\.", -1)
    n = F.transform(p, lambda x: F.when(x.rlike(r"^\d{1,3}$"), _num(x)))
    return F.when((F.size(p) == 4) & F.forall(n, lambda x: x.isNotNull() & (x <= 255)), F.aggregate(n, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x))


def ipv4_text(v: Column) -> Column:
    part = lambda s: F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def in_subnet(v: Column, net: Column, mask: Column) -> Column:
    return v.bitwiseAND(mask) == net.bitwiseAND(mask)


def is_multicast(v: Column) -> Column:
    return F.shiftright(v, 28) == 14


def endpoint(text: Column) -> Column:
    """struct<host, port> of `host:port` or `[v6]:port`; without a port it is null."""
    p = r"^\s*(\[[^\]]*\]|[^:]+)(?::(\d+))?\s*$"
    return F.when(text.rlike(p), F.struct(F.btrim(F.regexp_extract(text, p, 1), F.lit("[]")).alias("host"), _num(_match(text, p, 2), "int").alias("port")))
