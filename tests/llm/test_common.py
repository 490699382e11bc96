import numpy as np

from ledgerloom.llm.common import Remembered, ragged


def test_rows_of_numbers():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert ragged(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_strings_used_again_stay_remembered():
    """Beyond the limit only what is seldom used is learned anew (F1: all was)."""
    learned = []

    def learn(strings):
        learned.extend(strings)
        return np.array([ord(c) for s in strings for c in s], np.int64), np.array([len(s) for s in strings], np.int64)

    memory = Remembered(learn, 100)
    assert [x.tolist() for x in memory.of([])] == [[], []]
    for i in range(60):
        strings = ["often", "", "too", *[f"once{i}-{k}" for k in range(10)], "often"]
        values, size = memory.of(strings)
        assert values.tolist() == [ord(c) for s in strings for c in s] and size.tolist() == list(map(len, strings))
        assert len(memory.known) <= 100 + len(strings)
    assert learned.count("often") == learned.count("too") == learned.count("") == 1 and len(learned) == 603
    for i in range(9):  # more strings in use than may stay
        for _ in range(3):
            strings = [f"block{i}-{k}" for k in range(90)]
            values, size = memory.of(strings)
            assert values.tolist() == [ord(c) for s in strings for c in s] and size.tolist() == list(map(len, strings))
