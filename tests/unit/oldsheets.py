"""Small xls workbooks for the tests: records, and a compound file around them."""

import struct

END, FREE, TABLE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(value, size="H"):
    wide = any(ord(c) > 255 for c in value)
    return struct.pack(f"<{size}B", len(value.encode("utf-16-le")) // 2, int(wide)) + value.encode("utf-16-le" if wide else "latin-1")


def shared(values):
    return struct.pack("<II", len(values), len(values)) + b"".join(text(v) for v in values)


def cell(kind, row, column, body, style=0):
    return record(kind, struct.pack("<HHH", row, column, style) + body)


def book(sheets, strings=(b"",), formats=(0, 14), more=b""):
    """The workbook's stream. sheets: {name: records}; strings: the shared strings' record and its continue records."""
    head = record(0x809, struct.pack("<HHII", 0x600, 5, 0, 0) + b"\0" * 4) + more
    head += b"".join(record(0xE0, struct.pack("<HH", 0, f) + b"\0" * 16) for f in formats)
    table = b"".join(record(0x3C if k else 0xFC, part) for k, part in enumerate(strings)) if strings[0] else b""
    names = {n: text(n, "B") for n in sheets}
    size = len(head) + len(table) + 4 + sum(4 + 6 + len(t) for t in names.values())
    bounds, bodies = b"", b""
    for name, body in sheets.items():
        bounds += record(0x85, struct.pack("<IBB", size + len(bodies), 0, 0) + names[name])
        bodies += record(0x809, struct.pack("<HHII", 0x600, 0x10, 0, 0) + b"\0" * 4) + body + record(0x0A)
    return head + bounds + table + record(0x0A) + bodies


def compound(stream, name="Workbook", shift=9, mini=True):
    """A compound file with one stream; a short one is in the mini stream."""
    size = 1 << shift
    sectors, table = [], []

    def put(data, following=None):
        first = len(sectors)
        count = max(1, -(-len(data) // size))
        for k in range(count):
            sectors.append(data[k * size : (k + 1) * size].ljust(size, b"\0"))
            table.append(len(sectors) if k < count - 1 else END)
        return first

    def entry(label, kind, start, length):
        raw = label.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, FREE, FREE, FREE) + b"\0" * 36 + struct.pack("<IQ", start, length)

    is_mini = mini and len(stream) < 4096
    mini_table = END
    if is_mini:
        count = -(-len(stream) // 64)
        root = (put(stream.ljust(64 * count, b"\0")), 64 * count)
        chain = [k + 1 for k in range(count - 1)] + [END]
        mini_table = put(struct.pack(f"<{len(chain)}I", *chain).ljust(size, b"\xff"))
        own = (0, len(stream))
    else:
        root, own = (END, 0), (put(stream.ljust(4096, b"\0")), max(len(stream), 4096))
    directory = put(entry("Root Entry", 5, *root) + entry(name, 2, *own) + b"\0" * 256)
    n_tables = 1
    while (len(sectors) + n_tables) * 4 > n_tables * size:
        n_tables += 1
    first = len(sectors)
    table += [TABLE] * n_tables
    raw = struct.pack(f"<{len(table)}I", *table).ljust(n_tables * size, b"\xff")
    sectors += [raw[k * size : (k + 1) * size] for k in range(n_tables)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3 if shift == 9 else 4, 0xFFFE, shift, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, n_tables, directory, 0, 4096, mini_table, int(is_mini), END, 0)
    head += struct.pack("<109I", *range(first, first + n_tables), *[FREE] * (109 - n_tables))
    return head.ljust(size, b"\0") + b"".join(sectors)
