"""XXH32 (seed 0) of an address in canonical hex, as a column expression.

Intermediate values are bound by one-element array transforms. Written out as plain arithmetic the expression would grow
the generated Java method beyond the size the JVM compiles natively, which is several times slower.
"""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The five primes of the published XXH32 algorithm.
P1, P2, P3, P4, P5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
_M = 1 << 32
_MASK = _M - 1


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _mul(x: Column, prime: int) -> Column:
    """Product modulo 2**32 without leaving 64 bits."""
    return _low(x * (prime & 0xFFFF) + F.shiftleft((x * (prime >> 16)).bitwiseAND(F.lit(0xFFFF)), 16))


def _rotl(x: Column, bits: int) -> Column:
    return _low(F.shiftleft(x, bits)).bitwiseOR(F.shiftright(x, 32 - bits))


def _word(ip: Column, i: int) -> Column:
    return F.conv(F.substring(ip, 8 * i + 1, 8), 16, 10).cast("long")


def _swapped(x: Column) -> Column:
    """Byte order of a 32-bit number turned around: the hash reads addresses as little-endian words."""
    parts = [F.shiftleft(F.shiftright(x, 8 * b).bitwiseAND(F.lit(0xFF)), 24 - 8 * b) for b in range(4)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate once, use often."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _round(word: Column, add: Column | int, prime_in: int, bits: int, prime_out: int) -> Column:
    return _let(_low(_mul(word, prime_in) + add), lambda a: _let(_rotl(a, bits), lambda r: _mul(r, prime_out)))


def _finish(h: Column) -> Column:
    def step(value: Column, bits: int, then: Callable[[Column], Column]) -> Column:
        return _let(value, lambda v: _let(v.bitwiseXOR(F.shiftright(v, bits)), then))

    return step(h, 15, lambda a: step(_mul(a, P2), 13, lambda b: step(_mul(b, P3), 16, lambda c: c)))


def ip_hash(ip: Column) -> Column:
    """32-bit hash of an IPv4 (4 bytes) or IPv6 (16 bytes) address."""
    starts = F.array(*[F.lit(x) for x in ((P1 + P2) % _M, P2, 0, _M - P1)])
    short = _let(_swapped_word(ip, 0), lambda k: _round(k, P5 + 4, P3, 17, P4))
    words = F.array(*[_swapped_word(ip, i) for i in range(4)])
    lanes = F.transform(words, lambda k, i: _round(k, starts[i], P2, 13, P1))
    # Rotation by a column: multiply and split instead of a literal shift.
    turned = F.transform(lanes, lambda v, i: _let(v * F.element_at(F.array(*[F.lit(1 << b) for b in (1, 7, 12, 18)]), i + 1),
                                                  lambda w: _low(w).bitwiseOR(F.shiftright(w, 32))))
    long = F.aggregate(turned, F.lit(16).cast("long"), lambda total, v: _low(total + v))
    return _finish(F.when(F.length(ip) == 32, long).otherwise(short))


def _swapped_word(ip: Column, i: int) -> Column:
    return _let(_word(ip, i), _swapped)
