"""Workers of the pipeline's last stage hold small caches; what they encode stays the same."""

import public_tokenizers

from voxelgrain.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_small_caches_hold_little_and_give_the_same_ids():
    batches = [[f"w{k}x{i} y{k}{i}, z{i}{k}" for i in range(200)] for k in range(6)]
    whole, small = bpe.Encoder(PATH), bpe.Encoder(PATH, cache=100)
    for texts in batches:
        assert small.encode(texts) == whole.encode(texts)
    assert len(small.later) < len(whole.later) / 3 and len(small.pieces) < len(whole.pieces)
