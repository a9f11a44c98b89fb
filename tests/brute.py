"""Slow and plain counterparts of the block scans, for small inputs."""

import re


def lines_with_offsets(data: bytes):
    at, out = 0, []
    while at < len(data):
        end = data.find(b"\n", at)
        stop = len(data) if end < 0 else end + 1
        out.append((at, data[at:stop]))
        at = stop
    return out


def _text(lines):
    raw = b"".join(lines)
    raw = raw[:-1] if raw.endswith(b"\n") else raw
    return (raw[:-1] if raw.endswith(b"\r") else raw).decode()


def csv_records(data: bytes, header=True):
    """(idx, offset, length, text) of complete records."""
    lines = lines_with_offsets(data)
    out, open_lines, quotes, start = [], [], 0, 0
    for at, line in lines[1 if header else 0:]:
        if not open_lines:
            start = at
        open_lines.append(line)
        quotes += line.count(b'"')
        if quotes % 2 == 0:
            out.append((len(out), start, sum(map(len, open_lines)), _text(open_lines)))
            open_lines = []
    return out


def rule_records(data: bytes, start: str, end: str | None):
    """A record lasts from a start to its end, or else to the next start."""
    starts = [at + hit.start() for at, line in lines_with_offsets(data)
              for hit in re.finditer(start.encode(), line)]
    result = []
    for i, at in enumerate(starts):
        body = data[at:starts[i + 1] if i + 1 < len(starts) else len(data)]
        cut = re.search(end.encode(), body if body.endswith(b"\n") else body + b"\n") if end else None
        if cut:
            body = body[:cut.start()]
        text = body if cut else re.sub(rb"\r?\n\Z", b"", body)
        result.append((i, at, len(body), text.decode()))
    return result


def plain_records(data: bytes):
    out = []
    for at, line in lines_with_offsets(data):
        if _text([line]):
            out.append((len(out), at, len(line), _text([line])))
    return out


def log4j_segments(data: bytes):
    start, end = b"<log4j:event ", b"</log4j:event>"
    out, at = [], 0
    while True:
        stop = data.find(end, at)
        if stop < 0:
            return [(i, *x) for i, x in enumerate(out)]
        piece, base = data[at:stop + len(end)], at
        first = piece.find(start)
        while first >= 0:
            following = piece.find(start, first + 1)
            body = piece[first:following if following >= 0 else len(piece)]
            out.append((base + first, len(body), body.decode()))
            first = following
        at = stop + len(end)
