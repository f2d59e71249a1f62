"""A plain model of the optimal choices and their sizes, one value at a time, to hold the engine against."""


def up(bits):
    return -(-bits // 8)


def width(span):
    return max(1, span.bit_length())


def gaps(x, b):
    out, last = [], 0
    for v in x:
        out.append((v >> b) - last)
        last = v >> b
    return out


def optimal(values, variant):
    """(b, reversed, bytes)"""
    base = min(values)
    x = [v - base for v in values]
    n, tb = len(x), width(max(x))
    if variant == "rle":
        tb = 1 if max(x) == 0 else width(max(x) + 1)
        best = (n * tb, 0)
        for h in range(1, tb + 1):
            runs = 1 + sum((p >> (tb - h)) != (q >> (tb - h)) for p, q in zip(x, x[1:]))
            best = min(best, (n * (tb - h + 1) + runs * h, h), key=lambda c: c[0])
        h = best[1]
        runs = 1 + sum((p >> (tb - h)) != (q >> (tb - h)) for p, q in zip(x, x[1:]))
        return tb - h, False, up(n * (tb - h)) + (up(runs * h) + up(n) if h else 0) + 10
    fields = {"u": 11, "b": 10, "bstar": 10}[variant]
    best = (up(n * tb) + fields, tb, False)
    if variant == "bstar":
        raise NotImplementedError
    for b in range(1, tb):
        h, g = tb - b, gaps(x, b)
        for rev in (False, True) if variant == "u" else (False,):
            way = [-v for v in g] if rev else g
            if variant == "u":
                exc = [i == 0 or v < 0 or v >= h for i, v in enumerate(way)]
                unary = up(sum(v + 1 for v, e in zip(way, exc) if not e))
            else:
                exc = [i == 0 or abs(v) + 2 > h for i, v in enumerate(g)]
                unary = up(sum(max(v, 0) + 1 for v, e in zip(g, exc) if not e)) + up(sum(max(-v, 0) + 1 for v, e in zip(g, exc) if not e))
            size = up(n * b) + up(sum(exc) * h) + up(n) + unary + fields
            if size < best[0]:
                best = (size, b, rev)
    return best[1], best[2], best[0]
