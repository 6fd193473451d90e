"""Plain numpy versions on small series, by the definitions (all pairs)."""

import math
from statistics import NormalDist

import numpy as np

ND = NormalDist()


def kendall(t, y, st, res):
    s, var, slopes = 0, 0.0, []
    for g in sorted(set(st)):
        i = [k for k in range(len(t)) if st[k] == g and not np.isnan(y[k])]
        tt, yy = np.array([t[k] for k in i], float), np.array([y[k] for k in i])
        n = len(i)
        if n < 2:
            continue
        q = np.rint(yy / res)
        for a in range(n):
            for b in range(n):
                if tt[b] > tt[a]:
                    s += int(np.sign(q[b] - q[a]))
                    slopes.append((yy[b] - yy[a]) / (tt[b] - tt[a]))
        v = np.unique(q, return_counts=True)[1].astype(float)
        u = np.unique(tt, return_counts=True)[1].astype(float)
        f5 = lambda c: (c * (c - 1) * (2 * c + 5)).sum()
        var += (n * (n - 1) * (2 * n + 5) - f5(v) - f5(u)) / 18
        if n > 2:
            var += (v * (v - 1) * (v - 2)).sum() * (u * (u - 1) * (u - 2)).sum() / (9 * n * (n - 1) * (n - 2))
        var += (v * (v - 1)).sum() * (u * (u - 1)).sum() / (2 * n * (n - 1))
    return s, var, np.sort(slopes)


def p_value(s, var):
    z = 0.0 if s == 0 or var <= 0 else (s - np.sign(s)) / math.sqrt(var)
    return 2 * (1 - ND.cdf(abs(z)))


def median_slope(t, y):
    return float(np.median(kendall(t, y, [0] * len(t), 1e-9)[2]))


def lag1(y):
    a, b = y[1:], y[:-1]
    m = ~np.isnan(a) & ~np.isnan(b)
    return float(np.corrcoef(a[m], b[m])[0, 1])


def prewhitened(y, alpha=95.0):
    n = int((~np.isnan(y)).sum())
    r = lag1(y)
    if abs(r) < ND.inv_cdf(1 - (1 - alpha / 100) / 2) / math.sqrt(n):
        return r, y.copy(), False
    out = y.copy()
    out[0] = np.nan
    out[1:] = y[1:] - r * y[:-1]
    return r, out, True


def variants(t, y):
    r, pw, sig = prewhitened(y)
    if not sig or r >= 1 - 1e-3:
        return {k: y.copy() for k in ("pw", "pw_cor", "tfpw_y", "tfpw_ws", "vctfpw")}
    tr = np.asarray(t, float) - t[0]
    out = {"pw": pw, "pw_cor": pw / (1 - r)}
    b0, b0w = median_slope(t, y), median_slope(t, out["pw_cor"])
    c, a, _ = prewhitened(y - b0 * tr)
    out["tfpw_y"] = a + b0 * tr
    bv = b0 / math.sqrt((1 + c) / (1 - c)) if 0 <= c < 1 else b0
    out["vctfpw"] = a * np.nanvar(y, ddof=1) / np.nanvar(a, ddof=1) + bv * tr
    # iterative variant
    ak, x, ss = prewhitened(y - b0w * tr)
    if ss and ak < 1 - 1e-3:
        def white(k):
            w = y.copy()
            w[1:] = (y[1:] - k * y[:-1]) / (1 - k)
            return w

        prev, x = r, white(ak)
        b1, loops = median_slope(t, x), 0
        while abs(ak - prev) > 1e-4 and abs(b1 - b0w) > 1e-4 / 86400:
            loops += 1
            prev, b0w = ak, b1
            ak, _, ss = prewhitened(y - b1 * tr)
            if not (ak > 0 and ss) or ak >= 1 - 1e-3:
                break
            x = white(ak)
            b1 = median_slope(t, x)
            if loops > 10:
                break
    out["tfpw_ws"] = x
    return out
