"""Path functions as columns: no Python runs on the executors."""

from __future__ import annotations

import os
import platform
import re
import socket
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Systems whose file names are compared without case, lower-cased.
CASE_INSENSITIVE = ("mswin32", "win32", "cygwin", "msys", "darwin")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_case_insensitive_os(os) -> Column:
    return F.coalesce(F.lower(_col(os)).isin(*CASE_INSENSITIVE), F.lit(False))


def normalize_path(path, os, strip_all_dot_slash: bool = False) -> Column:
    """Forward slashes, none doubled, no leading './', no trailing slash but the root's, lower case where the system ignores case."""
    p = F.regexp_replace(F.translate(_col(path), "\\", "/"), "/+", "/")
    p = F.regexp_replace(p, r"^(\./)+" if strip_all_dot_slash else r"^\./", "")
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))
    return F.when(is_case_insensitive_os(os), F.lower(p)).otherwise(p)


def parts(path) -> Column:
    return F.filter(F.split(_col(path), "/"), lambda x: x != "")


def basename(path) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def parent(path) -> Column:
    """The directory above; null for the root."""
    own = parts(path)
    return F.when(F.size(own) > 0, F.array_join(F.slice(own, F.lit(1), F.size(own) - 1), "/"))


def depth(path) -> Column:
    """0 for the root, otherwise slashes and one."""
    p = _col(path)
    return F.when(p == "", F.lit(0)).otherwise(F.size(F.split(p, "/"))).cast("long")


def ancestors(path) -> Column:
    """The directories above, the nearest first and the root last."""
    own = parts(path)
    n = F.size(own)
    return F.when(n > 0, F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(own, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def node_key(hostname, volume, path) -> Column:
    return F.concat_ws("\0", _col(hostname), _col(volume), _col(path))


def key_str(hostname, volume, path) -> Column:
    p = _col(path)
    return F.concat_ws(":", _col(hostname), _col(volume), F.when(p == "", "<root>").otherwise(p))


def order_key(path, is_dir: bool) -> Column:
    """Sorts nodes of a volume as a walk visits them: a directory's files, then its
    directories, then itself.  NUL cannot occur in a name, so the string sorts by name."""
    own = parts(path)
    above = own if is_dir else F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))
    lead = F.array_join(F.transform(above, lambda x: F.concat(F.lit("1"), x, F.lit("\0"))), "")
    return F.concat(lead, F.lit("2") if is_dir else F.concat(F.lit("0"), basename(path)))


#: Stands before the two hex digits of a byte of a name that is not UTF-8.
ESCAPE = "\ufffd"
_ESCAPED = re.compile(ESCAPE + "([0-9a-f]{2})")


def name_text(raw: bytes) -> str:
    """A file name as text.  Bytes that are not UTF-8 are escaped, and so is the escape sign itself:
    different names have different texts."""
    text = raw.decode("utf-8", "surrogateescape")
    if text.isprintable() and ESCAPE not in text:
        return text
    out = []
    for c in text:
        if "\udc80" <= c <= "\udcff":
            out.append(f"{ESCAPE}{ord(c) - 0xDC00:02x}")
        else:
            out.append("".join(f"{ESCAPE}{b:02x}" for b in c.encode()) if c == ESCAPE else c)
    return "".join(out)


def name_bytes(text: str) -> bytes:
    """The name that name_text made a text of."""
    if ESCAPE not in text:
        return os.fsencode(text)
    raw, at = b"", 0
    for m in _ESCAPED.finditer(text):
        raw += text[at : m.start()].encode("utf-8", "surrogateescape") + bytes.fromhex(m[1])
        at = m.end()
    return raw + text[at:].encode("utf-8", "surrogateescape")


def os_name() -> str:
    return sys.platform


def default_hostname() -> str:
    return (socket.gethostname() or platform.node()).split(".")[0]
