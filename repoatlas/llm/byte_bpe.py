"""Token ids of texts by a byte-level BPE file, each distinct word tokenized once per worker.

The pre-tokenizer of such a file never joins characters across

* a single space between two characters that are not white space: the next unit starts there,
  with the space as its first character;
* a single newline between two such characters, which is a unit of its own;
* a Latin letter and the ``.,;:!?`` after it.

So the ids of a text are those of its units in order. ``cuts_at_spaces`` reads in the file
whether this holds; for any other file whole texts go to the tokenizer, as do the units
themselves here.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np

#: Units of one generation of the table, and the most characters of one; a worker keeps two
#: generations, some 300 MB. A distinct word that is met again is then seldom tokenized again.
CACHED_UNITS, CACHED_CHARS = 700_000, 40
#: A longer text is taken in parts of about this many characters.
PART = 1 << 20
#: Units that go to the tokenizer together.
TOGETHER = 64
ENDINGS = ".,;:!?"
#: A place that is a cut in any text, whatever the white space around it.
CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")


def cuts_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer described by ``spec`` is one that the rules above are true for."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        spec.get("normalizer") is None
        and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        and not split.get("add_prefix_space", True)
        and model["type"] == "BPE" and not model.get("dropout")
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])
            for t in spec.get("added_tokens", ())
        )
    )


def raw(ids: Iterable[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def latin_letter(c: str) -> bool:
    return c < "ɐ" and c.isalpha()


class TextIds:
    """Ids of texts as little-endian unsigned 32-bit integers, without special tokens added.

    Strings of the file's own special tokens inside a text become these tokens, as the
    tokenizer does it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = Tokenizer.from_file(path)
        self.mark = next((t["content"] for t in spec.get("added_tokens", ())), None)
        self.by_units = cuts_at_spaces(spec) and self.mark is not None
        #: " word" by "word", "\nword" by itself; False: no unit, as white space is at its ends.
        self.units: dict[str, bytes | bool] = {}
        self.old: dict[str, bytes | bool] = {}
        self.endings: dict[str, bytes] = {}
        self.long: list[str] = []
        if self.by_units:
            self.newline = self.whole("\n")
            self.mark_id = self.model.token_to_id(self.mark)

    def whole(self, text: str) -> bytes:
        return raw(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def each(self, strings: list[str]) -> list[bytes]:
        """Ids of each string; many go as one text, with a special token between them."""
        found: list[bytes] = []
        for i in range(0, len(strings), TOGETHER):
            part = strings[i : i + TOGETHER]
            text = self.mark.join(part)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(ids == self.mark_id) * 4).tolist()
            if len(ends) != len(part) - 1:  # one of them has the token itself
                found += map(self.whole, part)
                continue
            data = ids.tobytes()
            found += [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(data)])]
        return found

    def learn(self, keys: Iterable[str]) -> None:
        """Enter units that are in no table yet."""
        units, plain, others = self.units, [], []
        for key in keys:
            last = key[-1:]
            if key and last not in ENDINGS and not last.isspace() and not key[0].isspace():
                plain.append(key)
            else:
                others.append(key)
        units.update(zip(plain, self.each([f" {key}" for key in plain])))
        cores: list[tuple[str, str, str]] = []
        for key in others:
            head = "" if key[:1] == "\n" else " "
            word = key if head else key[1:]
            if not word or word[0].isspace() or word[-1].isspace():
                units[key] = False
                continue
            core = word.rstrip(ENDINGS)
            if not core or core == word or not latin_letter(core[-1]):
                core = word
            cores.append((key, head + core, word[len(core) :]))
        strings = list({core for _, core, _ in cores})
        ids = dict(zip(strings, self.each(strings)))
        for ending in {e for _, _, e in cores}.difference(self.endings, [""]):
            self.endings[ending] = self.whole(ending)
        for key, core, ending in cores:
            own = ids[core] + self.endings[ending] if ending else ids[core]
            units[key] = self.newline + own if key[0] == "\n" else own
        self.long += [key for key in chain(plain, others) if len(key) > CACHED_CHARS]

    def enter(self, keys: Iterable[str]) -> None:
        unknown = set(keys).difference(self.units)
        if self.old:
            known = [k for k in unknown if k in self.old]
            self.units.update((k, self.old[k]) for k in known)
            unknown.difference_update(known)
        self.learn(unknown)

    def forget(self) -> None:
        """Keep the tables small: long units go at once, the others by generations."""
        for key in self.long:
            self.units.pop(key, None)
        self.long = []
        if len(self.units) > CACHED_UNITS:
            self.old, self.units = self.units, {}
        if len(self.endings) > CACHED_UNITS // 10:
            self.endings = {}

    def joined(self, text: str, found: list[bytes | bool], head: bool) -> bytes:
        """Ids of a text from those of its units; ``head``: the first has a newline too many."""
        try:
            ids = b"".join(found)
        except TypeError:  # white space other than single spaces and newlines
            first, *rest = CUT.split(text)
            self.enter(rest)
            own = (self.units[s] for s in rest)
            return self.whole(first) + b"".join(
                self.whole(f" {s}") if ids is False else ids for s, ids in zip(rest, own)
            )
        return ids[len(self.newline) :] if head else ids

    def known(self, texts: list[list[str]]) -> list[list[bytes | bool]]:
        """The ids of all units of the texts; units that are not known yet are entered."""
        self.enter(set(chain.from_iterable(texts)).difference(self.units))
        get = self.units.__getitem__
        return [list(map(get, keys)) for keys in texts]

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts that end before a cut."""
        at = 0
        while len(text) - at > PART and (cut := CUT.search(text, at + PART)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """Per text its ids in pieces; the texts of one call should be small together."""
        if not self.by_units:
            for text in texts:
                yield iter([self.whole(text)])
            return
        keys = [("\n" + t).replace("\n", " \n").split(" ")[1:] if t and len(t) <= PART else [] for t in texts]
        found = [
            self.joined(text, ids, True) if ids else b"" for text, ids in zip(texts, self.known(keys))
        ]
        self.forget()
        for text, ids in zip(texts, found):
            yield iter([ids]) if len(text) <= PART else self.in_parts(text)

    def in_parts(self, text: str) -> Iterator[bytes]:
        for at, part in enumerate(self.parts(text)):
            shown = part if at else "\n" + part
            (found,) = self.known([shown.replace("\n", " \n").split(" ")[1:]])
            yield self.joined(part, found, not at)
            self.forget()


@cache
def text_ids(path: str) -> TextIds:
    """One table of units per worker process and tokenizer."""
    return TextIds(path)
