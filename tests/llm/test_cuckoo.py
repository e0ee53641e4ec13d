import random

from tessera.llm.cuckoo import CuckooFilter


def test_against_a_set():
    turn = random.Random(3)
    live = {turn.getrandbits(64) for _ in range(6000)}
    f = CuckooFilter.build(live, 100)
    assert all(h in f for h in live)
    f = CuckooFilter(slots=f.dump())
    for h in sorted(live)[::2]:
        assert f.delete(h)
        live.discard(h)
    assert all(h in f for h in live)
    false = sum(turn.getrandbits(64) in f for _ in range(20_000))
    assert false < 60


def test_insertion_without_room_changes_nothing():
    f, n = CuckooFilter(1), 0
    while f.insert((n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1):
        n += 1
    slots = f.dump()
    assert not f.insert((n + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) and f.dump() == slots
    assert n > 40 and all((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 in f for k in range(n))
