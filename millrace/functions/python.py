"""Functions that Spark's expressions can't say, as Arrow-batched UDFs.

``register`` puts them into a session under the names the catalogue uses.
"""

from __future__ import annotations

import base64
import datetime
import ipaddress
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _each(fn, *series) -> list:
    return [None if any(x is None or x is pd.NaT or (isinstance(x, float) and x != x) for x in row) else fn(*row) for row in zip(*series, strict=True)]


_M64 = (1 << 64) - 1
#: Multipliers of the published FarmHash 64-bit fingerprint.
_K0, _K1, _K2 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F


def farm_fingerprint(s: bytes) -> int:
    """The published 64-bit fingerprint, as a signed number."""

    def w(i: int, n: int = 8) -> int:
        return int.from_bytes(s[i : i + n], "little")

    def rot(x: int, k: int) -> int:
        return (x >> k | x << (64 - k)) & _M64

    def mix(x: int) -> int:
        return x ^ x >> 47

    def fold(u: int, v: int, m: int) -> int:
        a = mix((u ^ v) * m & _M64)
        return mix((v ^ a) * m & _M64) * m & _M64

    def weak(i: int, a: int, b: int) -> tuple[int, int]:
        p, q, r, t = (w(i + 8 * k) for k in range(4))
        a = a + p & _M64
        b = rot(b + a + t & _M64, 21)
        c = a
        a = a + q + r & _M64
        b = b + rot(a, 44) & _M64
        return a + t & _M64, b + c & _M64

    n = len(s)
    if n <= 16:
        if n >= 8:
            m = _K2 + 2 * n
            a, b = w(0) + _K2 & _M64, w(n - 8)
            return _signed(fold(rot(b, 37) * m + a & _M64, (rot(a, 25) + b) * m & _M64, m))
        if n >= 4:
            return _signed(fold(n + (w(0, 4) << 3) & _M64, w(n - 4, 4), _K2 + 2 * n))
        if n:
            y, z = s[0] + (s[n >> 1] << 8), n + (s[n - 1] << 2)
            return _signed(mix(y * _K2 & _M64 ^ z * _K0 & _M64) * _K2 & _M64)
        return _signed(_K2)
    if n <= 32:
        m = _K2 + 2 * n
        a, b, c, d = w(0) * _K1 & _M64, w(8), w(n - 8) * m & _M64, w(n - 16) * _K2 & _M64
        return _signed(fold(rot(a + b & _M64, 43) + rot(c, 30) + d & _M64, a + rot(b + _K2 & _M64, 18) + c & _M64, m))
    if n <= 64:
        m = _K2 + 2 * n
        a, b, c, d = w(0) * _K2 & _M64, w(8), w(n - 8) * m & _M64, w(n - 16) * _K2 & _M64
        y = rot(a + b & _M64, 43) + rot(c, 30) + d & _M64
        z = fold(y, a + rot(b + _K2 & _M64, 18) + c & _M64, m)
        e, f, g, h = w(16) * m & _M64, w(24), (y + w(n - 32)) * m & _M64, (z + w(n - 24)) * m & _M64
        return _signed(fold(rot(e + f & _M64, 43) + rot(g, 30) + h & _M64, e + rot(f + a & _M64, 18) + g & _M64, m))
    x, y = 81, 81 * _K1 + 113 & _M64
    z = mix(y * _K2 + 113 & _M64) * _K2 & _M64
    v, u = (0, 0), (0, 0)
    x = x * _K2 + w(0) & _M64
    end, i = (n - 1) // 64 * 64, 0
    while i < end:
        x = rot(x + y + v[0] + w(i + 8) & _M64, 37) * _K1 & _M64
        y = rot(y + v[1] + w(i + 48) & _M64, 42) * _K1 & _M64
        x ^= u[1]
        y = y + v[0] + w(i + 40) & _M64
        z = rot(z + u[0] & _M64, 33) * _K1 & _M64
        v = weak(i, v[1] * _K1 & _M64, x + u[0] & _M64)
        u = weak(i + 32, z + u[1] & _M64, y + w(i + 16) & _M64)
        z, x = x, z
        i += 64
    m = _K1 + ((z & 0xFF) << 1) & _M64
    i = n - 64
    u = (u[0] + ((n - 1) & 63) & _M64, u[1])
    v = (v[0] + u[0] & _M64, v[1])
    u = (u[0] + v[0] & _M64, u[1])
    x = rot(x + y + v[0] + w(i + 8) & _M64, 37) * m & _M64
    y = rot(y + v[1] + w(i + 48) & _M64, 42) * m & _M64
    x ^= u[1] * 9 & _M64
    y = y + v[0] * 9 + w(i + 40) & _M64
    z = rot(z + u[0] & _M64, 33) * m & _M64
    v = weak(i, v[1] * m & _M64, x + u[0] & _M64)
    u = weak(i + 32, z + u[1] & _M64, y + w(i + 16) & _M64)
    z, x = x, z
    return _signed(fold(fold(v[0], u[0], m) + mix(y) * _K0 + z & _M64, fold(v[1], u[1], m) + x & _M64, m))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def initcap(s: str, delimiters: str) -> str:
    """Upper case after each delimiter and at the start, lower case elsewhere."""
    out, up = [], True
    for c in s:
        out.append(c.upper() if up else c.lower())
        up = c in delimiters
    return "".join(out)


def instr(s: str, part: str, position: int, occurrence: int) -> int:
    """The place of the n-th occurrence, from a position on; backwards from the end if it is negative."""
    if position < 0:
        at = len(s) + position + 1
        for _ in range(occurrence):
            at = s.rfind(part, 0, at + len(part) - 1)
            if at < 0:
                return 0
        return at + 1
    at = position - 2
    for _ in range(occurrence):
        at = s.find(part, at + 1)
        if at < 0:
            return 0
    return at + 1


def strftime(fmt: str, t: datetime.datetime) -> str:
    """strftime with the dialect's own %E4Y, %E#S, %E*S and %Q."""
    t = t.to_pydatetime() if hasattr(t, "to_pydatetime") else t

    def own(m: re.Match) -> str:
        k = m[1]
        if k == "E4Y":
            return f"{t.year:04d}"
        if k == "Q":
            return str((t.month + 2) // 3)
        if k == "E*S":
            return f"{t.second:02d}" + (f".{t.microsecond:06d}".rstrip("0") if t.microsecond else "")
        return f"{t.second:02d}" + (f".{t.microsecond:06d}"[: 1 + int(k[1])] if k[1] != "0" else "")

    return t.strftime(re.sub(r"%(E4Y|Q|E\*S|E\dS)", own, fmt))


def strptime(fmt: str, s: str) -> datetime.datetime:
    """strptime; a missing part is that of 1970-01-01."""
    had_year = re.search(r"%[YyCGFDcxs]|%E4Y", fmt) is not None
    fmt = fmt.replace("%E4Y", "%Y").replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S").replace("%R", "%H:%M").replace("%D", "%m/%d/%y")
    fmt = re.sub(r"%E[\d*]S", "%S.%f" if "." in s else "%S", fmt)
    t = datetime.datetime.strptime(s.strip(), fmt.strip())
    return t if had_year else t.replace(year=1970)


def format_string(fmt: str, args) -> str:
    """FORMAT: %d %i %u %x %o %f %e %g %s %t %T %% with flags; %'d groups digits."""
    it = iter(args)

    def one(m: re.Match) -> str:
        flags, width, precision, kind = m.groups()
        if kind == "%":
            return "%"
        v = next(it)
        if v is None:
            return "NULL"
        group = "'" in flags
        flags = flags.replace("'", "")
        if kind in "di":
            text = f"{int(v):,d}" if group else str(int(v))
            return ("%" + flags + (width or "") + "s") % text if group or "0" not in flags else ("%" + flags + (width or "") + "d") % int(v)
        if kind in "uxXo":
            return ("%" + flags + (width or "") + kind.replace("u", "d")) % int(v)
        if kind in "fFeEgG":
            return ("%" + flags + (width or "") + (precision or "") + kind) % float(v)
        text = json.dumps(v) if kind == "T" and not re.fullmatch(r"-?\d+(\.\d+)?|true|false", v) else v
        return ("%" + flags + (width or "") + (precision or "") + "s") % text

    return re.sub(r"%([-+ 0#']*)(\d+)?(\.\d+)?([diuxXofFeEgGstT%])", one, fmt)


def _path(path: str) -> list:
    return [int(b) if b else a or c for a, b, c in re.findall(r"\.([A-Za-z_][\w-]*)|\[(\d+)\]|[.\[]?\[?['\"]([^'\"]*)['\"]\]?", path.lstrip("$"))]


def json_edit(doc: str, path: str, change) -> str:
    """Apply ``change(container, key)`` at a path; absent objects on the way are made."""
    root = [json.loads(doc)]
    at, key = root, 0
    for step in _path(path):
        if at[key] is None:
            at[key] = {} if isinstance(step, str) else []
        at, key = at[key], step
        if isinstance(at, dict) and isinstance(key, str):
            at.setdefault(key, None)
        elif isinstance(at, list) and isinstance(key, int):
            at.extend([None] * (key + 1 - len(at)))
        else:
            return doc
    change(at, key)
    return json.dumps(root[0], separators=(",", ":"))


def _set(doc, path, v):
    value = json.loads(v).get("v")
    return json_edit(doc, path, lambda c, k: c.__setitem__(k, value))


def _append(doc, path, v):
    value = json.loads(v).get("v")
    return json_edit(doc, path, lambda c, k: c[k].append(value) if isinstance(c[k], list) else c.__setitem__(k, [value]) if c[k] is None else None)


def _strip(x):
    return {k: _strip(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [_strip(v) for v in x] if isinstance(x, list) else x


def json_type(doc: str) -> str:
    """object, array, string, number, boolean or null."""
    x = json.loads(doc)
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")


#: Two-label public suffixes known here; any other last label is a suffix.
SUFFIXES = {"co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "co.nz", "co.in", "com.cn", "co.kr", "co.za", "com.mx", "com.tr"}


def net_host(url: str) -> str | None:
    """The host of a URL, as written."""
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)", url)
    return m[1] if m else None


def public_suffix(url: str) -> str | None:
    """The host's public suffix."""
    labels = (net_host(url) or url.strip()).rstrip(".").split(".")
    if len(labels) < 1 or not labels[-1] or re.fullmatch(r"[\d.]+", ".".join(labels)):
        return None
    return ".".join(labels[-2:]) if ".".join(labels[-2:]).lower() in SUFFIXES else labels[-1]


def reg_domain(url: str) -> str | None:
    """The public suffix and the label before it."""
    suffix = public_suffix(url)
    labels = (net_host(url) or url.strip()).rstrip(".").split(".")
    n = suffix.count(".") + 2 if suffix else 0
    return ".".join(labels[-n:]) if n and len(labels) >= n else None


def _safe(fn):
    def run(*a):
        try:
            return fn(*a)
        except ValueError:
            return None

    return run


def _mask(out: int, bits: int) -> bytes:
    return ((1 << 8 * out) - (1 << (8 * out - bits))).to_bytes(out, "big")


def _decompress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _compress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


_SCALARS = {
    "farm_fingerprint": (farm_fingerprint, "bigint"),
    "initcap": (initcap, "string"),
    "instr": (instr, "bigint"),
    "chr": (lambda n: chr(int(n)) if n else "", "string"),
    "to_code_points": (lambda s: [ord(c) for c in s] if isinstance(s, str) else list(s), "array<bigint>"),
    "code_points_to_string": (lambda a: "".join(map(chr, map(int, a))), "string"),
    "code_points_to_bytes": (lambda a: bytes(map(int, a)), "binary"),
    "normalize": (lambda s, form: unicodedata.normalize(form, s), "string"),
    "normalize_and_casefold": (lambda s, form: unicodedata.normalize(form, unicodedata.normalize(form, s).casefold()), "string"),
    "format": (format_string, "string"),
    "to_base32": (lambda b: base64.b32encode(b).decode(), "string"),
    "from_base32": (lambda s: base64.b32decode(s), "binary"),
    "zstd_compress": (_compress, "binary"),
    "zstd_decompress": (_decompress, "binary"),
    "strftime": (strftime, "string"),
    "strptime": (strptime, "timestamp_ntz"),
    "json_type": (json_type, "string"),
    "json_set": (_set, "string"),
    "json_remove": (lambda d, p: json_edit(d, p, lambda c, k: c.__delitem__(k)), "string"),
    "json_array_append": (_append, "string"),
    "json_strip_nulls": (lambda d: json.dumps(_strip(json.loads(d)), separators=(",", ":")), "string"),
    "net_host": (net_host, "string"),
    "net_public_suffix": (public_suffix, "string"),
    "net_reg_domain": (reg_domain, "string"),
    "ip_from_string": (lambda s: ipaddress.ip_address(s).packed, "binary"),
    "safe_ip_from_string": (_safe(lambda s: ipaddress.ip_address(s).packed), "binary"),
    "ip_to_string": (lambda b: str(ipaddress.ip_address(bytes(b))), "string"),
    "ip_net_mask": (_mask, "binary"),
    "ip_trunc": (lambda b, n: bytes(x & y for x, y in zip(b, _mask(len(b), n), strict=True)), "binary"),
    "ip_in_net": (lambda a, n: ipaddress.ip_address(a) in ipaddress.ip_network(n, strict=False), "boolean"),
}


def _udf(fn, kind: str):
    """A batched UDF of as many arguments as ``fn`` has (wrappers of any number take one)."""
    n = 1 if fn.__code__.co_flags & 4 else fn.__code__.co_argcount
    return {1: _one, 2: _two, 3: _three, 4: _four}[n](fn, kind)


def _one(fn, kind):
    def run(a: pd.Series) -> pd.Series:
        return pd.Series(_each(fn, a), dtype=object)

    return F.pandas_udf(run, kind)


def _two(fn, kind):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_each(fn, a, b), dtype=object)

    return F.pandas_udf(run, kind)


def _three(fn, kind):
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(_each(fn, a, b, c), dtype=object)

    return F.pandas_udf(run, kind)


def _four(fn, kind):
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_each(fn, a, b, c, d), dtype=object)

    return F.pandas_udf(run, kind)


def _guarded(fn):
    """``fn`` with None where it raises; it keeps the number of arguments."""
    n = 1 if fn.__code__.co_flags & 4 else fn.__code__.co_argcount
    call = _safe(fn)
    return {1: lambda a: call(a), 2: lambda a, b: call(a, b), 3: lambda a, b, c: call(a, b, c), 4: lambda a, b, c, d: call(a, b, c, d)}[n]


def register(spark: SparkSession) -> None:
    """Register all of them with a session, once."""
    if getattr(spark, "_mr_registered", False):
        return
    for name, (fn, kind) in _SCALARS.items():
        spark.udf.register(f"mr_{name}", _udf(fn, kind))
        spark.udf.register(f"mr_safe_{name.removeprefix('safe_')}", _udf(_guarded(fn), kind))
    spark._mr_registered = True
