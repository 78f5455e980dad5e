"""A plain encoder and decoder of serialized values, for the tests only."""


class Std(dict):
    """A plain object; its items are its properties."""


def encode(value) -> bytes:
    if value is None:
        return b"N;"
    if isinstance(value, bool):
        return b"b:%d;" % value
    if isinstance(value, int):
        return b"i:%d;" % value
    if isinstance(value, float):
        return b"d:%s;" % repr(value).encode()
    if isinstance(value, str):
        raw = value.encode()
        return b's:%d:"%s";' % (len(raw), raw)
    pairs = list(enumerate(value)) if isinstance(value, list) else list(value.items())
    body = b"".join(encode(k) + encode(v) for k, v in pairs)
    if isinstance(value, Std):
        return b'O:8:"stdClass":%d:{%s}' % (len(pairs), body)
    return b"a:%d:{%s}" % (len(pairs), body)


def _value(raw: bytes, at: int):
    mark = raw[at : at + 1]
    if mark == b"N":
        return None, at + 2
    if mark in b"bid":
        end = raw.index(b";", at)
        text = raw[at + 2 : end].decode()
        return {"b": lambda t: t == "1", "i": int, "d": float}[mark.decode()](text), end + 1
    colon = raw.index(b":", at + 2)
    size = int(raw[at + 2 : colon])
    if mark == b"s":
        start = colon + 2
        assert raw[start + size : start + size + 2] == b'";'
        return raw[start : start + size].decode(), start + size + 2
    made = {}
    if mark == b"O":
        assert raw[colon + 2 : colon + 10] == b"stdClass"
        start = colon + 12
        colon = raw.index(b":", start)
        size, made = int(raw[start:colon]), Std()
    at = colon + 2
    for _ in range(size):
        key, at = _value(raw, at)
        made[key], at = _value(raw, at)
    assert raw[at : at + 1] == b"}"
    return made, at + 1


def decode(raw: bytes):
    value, end = _value(raw, 0)
    assert end == len(raw)
    return value
