"""Texts of millions of bytes, and single runs without a space, through the text operators within bounded memory."""

import random
import subprocess
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm.tokens import Merger

JSON = public_tokenizers.path("byte_bpe_50k.json")


def runs(n):
    rng = random.Random(8)
    letters = "etaoinshrdlu"
    return {"letters": "".join(rng.choice(letters) for _ in range(n)), "same": "a" * n, "accents": "éü" * (n // 2), "digits": "".join(rng.choice("0123456789") for _ in range(n)), "hashes": "#*$" * (n // 3)}


@pytest.mark.parametrize("name", runs(3))
@pytest.mark.parametrize("n", [50, 5_000, 60_000])
def test_unbroken_runs_count_as_the_library_counts(name, n):
    text = runs(n)[name]
    want = len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids)
    assert Merger(JSON).text(text) == want


def peak(code: str) -> float:
    """MB that a fresh interpreter comes to beyond what the imports take, running ``code``."""
    script = "import resource\nfrom corpuslens.llm import tokens, lattice, substrings\nimport pyarrow as pa, numpy as np, random\nbase = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n" + code + "\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) / 1024)"
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600, check=True, env={**__import__("os").environ, "PYTHONPATH": sys.path[0]})
    return float(out.stdout.split()[-1])


def test_count_of_a_long_run_is_bounded():
    code = f"m = tokens.Merger({JSON!r})\nt = ''.join(random.Random(1).choices('etaoinshrdlu', k=3_000_000))\nassert m.text(t) > 0"
    assert peak(code) < 300


def test_windows_of_a_long_text_are_bounded():
    code = "t = ' '.join(random.Random(1).choices([f'w{i}' for i in range(5000)], k=1_800_000))\nw = substrings._Words(pa.array([t]))\ne = substrings._entries(w.hashes, w.firsts)\nassert len(e[0]) > 100_000"
    assert peak(code) < 500


def test_sampling_of_a_long_run_is_bounded_and_lossless():
    model = public_tokenizers.path("piece_bpe_32k.model")
    code = f"l = lattice.Lattice({model!r})\nt = ''.join(random.Random(1).choices('etaoinshrdlu', k=1_500_000))\nids, f = l.encode([t], np.array([5], np.uint64))\nassert l.decode(ids.tolist()) == t"
    assert peak(code) < 500
