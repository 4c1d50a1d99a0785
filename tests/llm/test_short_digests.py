import pytest
from tests.llm.test_digest import prose

from quillspark.llm import digest


@pytest.mark.parametrize("n", [16, 24, 40, 63, 64, 100, 127, 128, 180, 255, 256])
def test_half_shared_short_texts_are_alike(n):
    for seed in range(20):
        text, following = prose(80, seed)[:n], prose(80, seed + 100)
        x, half, other = digest.digests([text, digest.edited(text, following), following[:n]])
        assert digest.likeness(x, half) > 0.1
        assert digest.likeness(x, half) > digest.likeness(x, other)


def test_runs_of_one_byte_are_no_features():
    assert len(digest.short_features(b"-" * 40)) == 0 and len(digest.short_features(b"abcd")) == 1
    x, y = digest.digests(["-" * 40 + "one", "-" * 40 + "two"])
    assert digest.likeness(x, y) < 0.5


def test_a_side_just_longer_than_short_texts():
    for seed in range(20):
        text = prose(200, seed)[:255]
        x, y = digest.digests([text, text[:128] + prose(200, seed + 100)[:140]])
        assert digest.likeness(x, y) > 0
