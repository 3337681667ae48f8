"""What a Python worker keeps between tasks stands beside the next stage on its executor, so it is bounded."""

from __future__ import annotations

import subprocess
import sys

from echotrail.llm import packing


def test_encoder_keeps_few_words():
    words = packing.WordTokens(packing.default_vocabulary())
    letters = "abcdefghijklmnopqrstuvwxyz"
    for part in range(9):
        made = (f"{letters[part]}{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676 % 26]}{letters[i // 17576 % 26]}q" for i in range(50_000))
        words.encode([" ".join(made).encode()])
    assert 0 < len(words.index) <= 360_000
    assert 0 < len(words.letters) <= 400_000


def test_near_copies_load_no_pandas():
    check = "import sys, echotrail.llm.near_copies; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", check]).returncode == 0
