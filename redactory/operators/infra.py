"""Infrastructure details of fixed form: URL hosts, file paths, IP and MAC addresses. Functions over one text, for the scan's one Arrow stage."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from redactory.functions.lexicon import HOME_ROOTS, IDENTIFYING_ROOTS, INTERNAL_HINTS, LOOPBACK_HOSTS, PLAIN_IPV4, PLAIN_IPV6, REAL_ROOTS
from redactory.operators.spans import Found

# Patterns of the rules.
_URL = re.compile(r"(?<![A-Za-z0-9_])https?://[^\s\"'`<>\\]+")
_UNIX = re.compile(r"(?<![A-Za-z0-9_])/(?:[A-Za-z0-9_.-]+/)++[A-Za-z0-9_.-]*+")
_WINDOWS = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]:\\(?:[^\\\s]+\\)*+[^\\\s]*+")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = re.compile(rf"(?<![A-Za-z0-9_])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9_])")
_DOTTED = re.compile(r"[0-9]\.[0-9]{1,3}\.")
_PRIVATE = re.compile(r"(?<![A-Za-z0-9_])(?:10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3})(?![A-Za-z0-9_])")
_MAC = re.compile(r"(?<![A-Za-z0-9_])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![A-Za-z0-9_])")
_V6 = re.compile(r"[0-9A-Fa-f:]{2,}")

_HINTS, _REAL, _HOME, _TELLING = map(frozenset, (INTERNAL_HINTS, REAL_ROOTS, HOME_ROOTS, IDENTIFYING_ROOTS))
_LOOPBACK, _QUIET4, _QUIET6 = map(frozenset, (LOOPBACK_HOSTS, PLAIN_IPV4, PLAIN_IPV6))
_OPENERS = {")": "(", "]": "[", "}": "{"}


def cut_tail(value: str) -> str:
    """Without stops and quotes at the end, and without closing brackets that nothing in it opens."""
    end = len(value)
    surplus = {c: value.count(c) - value.count(o) for c, o in _OPENERS.items()}
    while end:
        c = value[end - 1]
        if c in surplus and surplus[c] > 0:
            surplus[c] -= 1
        elif c not in ".,;:!?'\"":
            break
        end -= 1
    return value[:end]


def is_internal(host: str) -> bool:
    low = host.lower()
    return bool(_PRIVATE.search(host)) or low.endswith((".local", ".internal")) or not _HINTS.isdisjoint(re.split(r"[.\-_]", low))


def is_loopback(host: str) -> bool:
    low = host.lower()
    return low in _LOOPBACK or low.startswith("127.") or low.endswith(".localhost")


_AUTHORITY = re.compile(r"(https?)://([^/?#]*)", re.I)
_DEFAULT_PORT = {"http": "80", "https": "443"}
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


def authority_of(url: str) -> tuple[str, str] | None:
    """(host, port) as a browser reads them: lower case, no user, no default port. None where it would refuse."""
    m = _AUTHORITY.match(url)
    if not m:
        return None
    rest = m[2].rpartition("@")[2]
    if rest.startswith("["):
        host, _, tail = rest.partition("]")
        host += "]"
        if tail and not tail.startswith(":"):
            return None
        port = tail[1:]
    else:
        host, _, port = rest.partition(":")
        if not host or _FORBIDDEN.search(host):
            return None
    if port and not (port.isascii() and port.isdigit() and int(port) <= 65535):
        return None
    port = str(int(port)) if port else ""
    return host.lower(), "" if port == _DEFAULT_PORT[m[1].lower()] else port


def urls(text: str) -> tuple[list[Found], list[tuple[int, int]]]:
    """Spans of the hosts of URLs (with their port), and the ranges that URLs take, loopback ones included."""
    found, ranges = [], []
    for m in _URL.finditer(text):
        ranges.append(m.span())
        value = cut_tail(m[0].split("${", 1)[0])
        if not re.match(r"https?://\S", value):
            continue
        known = authority_of(value)
        host = known[0] if known else ""
        if host and is_loopback(host):
            continue
        shown = f"{host}:{known[1]}" if known and known[1] else host
        at = value.find(shown) if shown else -1
        start, kept = (m.start() + at, shown) if at >= 0 else (m.start(), value)
        internal = bool(host) and is_internal(host)
        found.append(("internal-url" if internal else "external-url", "Internal URL Host" if internal else "URL Host", "medium" if internal else "low", "INFRA", kept, start, start + len(kept)))
    return found, ranges


class Ranges:
    """Ranges in order that don't overlap each other, for tests of overlap."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.ranges = sorted(ranges)
        self.starts = [a for a, _ in self.ranges]
        reach, self.reach = 0, []
        for _, b in self.ranges:
            reach = max(reach, b)
            self.reach.append(reach)

    def touch(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start

    def hold(self, start: int, end: int) -> bool:
        """Whether one of the ranges, which must be disjoint, contains a range."""
        i = bisect_right(self.starts, start)
        return i > 0 and self.ranges[i - 1][1] >= end


def _path_label(home: bool) -> str:
    return "File Path (home directory — exposes account name)" if home else "File Path"


def paths(text: str, taken: Ranges) -> list[Found]:
    found = []
    for m in _UNIX.finditer(text):
        value = cut_tail(m[0])
        start, end = m.start(), m.start() + len(value)
        parts = value.split("/")
        root, named = (parts[1] if len(parts) > 1 else ""), len(parts) > 2 and parts[2] != ""
        if len(value) < 4 or taken.touch(start, end) or (start and text[start - 1] == "."):
            continue
        if root not in _REAL or root not in _TELLING or not (named or root == "root"):
            continue
        found.append(("unix-file-path", _path_label(root in _HOME), "low", "INFRA", value, start, end))
    for m in _WINDOWS.finditer(text):
        if value := cut_tail(m[0]):
            home = re.match(r"[A-Za-z]:\\Users\\[^\\]", value, re.I) is not None
            found.append(("windows-file-path", _path_label(home), "low", "INFRA", value, m.start(), m.start() + len(value)))
    return found


def ipv4(text: str, taken: Ranges) -> list[Found]:
    found = []
    for m in _IP.finditer(text):
        if m[0] in _QUIET4 or taken.touch(*m.span()):
            continue
        private = _PRIVATE.search(m[0]) is not None
        found.append(("private-ip-standalone" if private else "public-ip-standalone", "Internal IP Address" if private else "IP Address", "medium" if private else "low", "INFRA", m[0], *m.span()))
    return found


def is_ipv6(value: str) -> bool:
    """Eight groups, or up to seven with one gap; stray single colons at an end are let through."""
    sides = value.split("::")
    groups = [g for side in sides for g in side.split(":") if g]
    return all(len(g) <= 4 for g in groups) and (len(groups) == 8 if len(sides) == 1 else len(sides) == 2 and len(groups) <= 7)


def ipv6(text: str, taken: Ranges) -> list[Found]:
    found = []
    for m in _V6.finditer(text):
        value = m[0]
        if ":" not in value or value in _QUIET6 or taken.touch(*m.span()) or not is_ipv6(value):
            continue
        around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if re.search("[A-Za-z0-9_]", around) or sum(map(bool, value.split(":"))) < 2 or not re.search("[0-9]", value):
            continue
        local = value.lower().startswith("fe80:")
        found.append(("ipv6-link-local" if local else "ipv6-standalone", "IPv6 Link-Local Address" if local else "IPv6 Address", "low" if local else "medium", "INFRA", value, *m.span()))
    return found


def infra_spans(text: str) -> list[Found]:
    """URL hosts, MAC addresses, paths, IPv4 and IPv6 addresses in order of place; the first two take their text from the others."""
    hosts, ranges = urls(text) if "http" in text else ([], [])
    pairs = text.count(":") + text.count("-") >= 5
    macs = [("mac-address", "MAC Address", "medium", "INFRA", m[0], *m.span()) for m in _MAC.finditer(text)] if pairs else []
    taken = Ranges([*ranges, *(x[5:] for x in macs)])
    found = [*hosts, *macs]
    if "/" in text or "\\" in text:
        found += paths(text, taken)
    if _DOTTED.search(text):
        found += ipv4(text, taken)
    if "::" in text or text.count(":") >= 7:
        found += ipv6(text, taken)
    return sorted(found, key=lambda x: x[5])
