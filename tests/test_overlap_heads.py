"""Windows are looked up by few lengths of their heads."""

from quillspark.operators import overlap


def test_lengths_of_heads_are_few():
    widths = {overlap.window_places(n)[0] for n in range(1, 2000)}
    heads = {overlap.head_of(w) for w in widths}
    assert len(widths) > 90 and len(heads) <= 18 and all(overlap.head_of(w) <= w < 2 * overlap.head_of(w) for w in widths)
