"""Deterministic stand-ins for models: they recognize nothing."""

import hashlib


def stand_in_words():
    """Text bytes as words half a second apart."""
    return lambda content: [{"word": w, "start": i * 0.5, "end": i * 0.5 + 0.4, "score": 0.9} for i, w in enumerate(bytes(content).decode().split())]


def stand_in_embedder(size: int = 8):
    """A unit vector from a hash of the bytes."""

    def embed(content) -> list[float]:
        raw = [b - 127.5 for b in hashlib.sha256(bytes(content)).digest()[:size]]
        length = sum(x * x for x in raw) ** 0.5
        return [x / length for x in raw]

    return embed


def stand_in_speech():
    def has_speech(content) -> bool:
        if not content:
            raise ValueError("no sound")
        return len(bytes(content).split()) > 0

    return has_speech


def stand_in_voice():
    """A text and a voice to bytes of both."""
    return lambda text, voice: f"{voice}:{text}".encode()


def failing():
    def fail(*inputs):
        raise RuntimeError("no model")

    return fail


def stand_in_phones():
    def frames(content) -> list[str]:
        said = bytes(content).decode().split()
        if said == ["fail"]:
            raise RuntimeError("no phones")
        return said

    return frames


def stand_in_matcher():
    """The share of equal letters."""

    def score(content, keyword: str) -> float:
        said = bytes(content).decode()
        if said == "fail":
            raise ValueError("no match")
        return float("nan") if said == "nan" else sum(a == b for a, b in zip(said, keyword)) / len(keyword)

    return score


def stand_in_text():
    return lambda content: bytes(content).decode()


def stand_in_conversion():
    return lambda content, reference: bytes(content) + b" as " + bytes(reference)


def stand_in_denoiser():
    return lambda content: bytes(content).replace(b" ", b"_")
