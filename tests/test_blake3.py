from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions.blake3 import digests, hex_digest, revs

# Published vectors: input is 0..250 repeated, by length.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
}


def test_vectors():
    whole = bytes(i % 251 for i in range(31744))
    assert {n: hex_digest(whole[:n]) for n in VECTORS} == VECTORS


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(max_size=5000), max_size=8))
def test_many_at_once_are_as_one_by_one(messages):
    assert digests(messages) == [digests([m])[0] for m in messages]
    assert revs(messages) == [hex_digest(m)[:16] for m in messages]
