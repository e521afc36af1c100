"""Notices whose windows join are all found."""

from cardwarden.llm import licenses


def test_adjacent_notices_with_falling_edits():
    scan = licenses.Scanner(licenses.NOTICES, licenses.PHRASES)
    exact, off = "licensed under cc by nc 4 0", "licensed undr cc by nc 4 0"
    for parts in ([off, exact], [exact, off], ["licensd undr cc by nc 4 0", off, exact], [exact] * 3):
        found = [s for s in scan.spans(" ".join(parts)) if s[0] == "cc-by-nc"]
        assert [s[3] for s in found] == [len(exact) - len(p) for p in parts]
        assert [s[1] for s in found] == [7 * i for i in range(len(parts))]
