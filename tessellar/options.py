"""What a caller asks of a decoding, checked before any work."""

from __future__ import annotations

from dataclasses import dataclass

from tessellar.codecs.pixels import FORMATS
from tessellar.status import CodecError, INVALID_ARGUMENT, TOO_LARGE

COMPOSITED, SUBFRAME = "composited", "subframe"


@dataclass(frozen=True)
class Options:
    """fmt: an output format, or None for the frame's own. crop: left, top, width, height. scale: width and height, one of them 0 to keep
    the proportions. chroma: 0 nearest, 1 fancy, 2 three taps, 3 ten taps. limit: greatest number of pixels of a canvas or a scaled picture (0: none)."""

    fmt: str | None = None
    crop: tuple[int, int, int, int] | None = None
    scale: tuple[int, int] | None = None
    flip: bool = False
    chroma: int = 1
    bypass_filter: bool = False
    animation: str = COMPOSITED
    limit: int = 0

    def check(self) -> Options:
        def wrong(what: str) -> CodecError:
            return CodecError(INVALID_ARGUMENT, what)

        if self.fmt is not None and self.fmt not in FORMATS:
            raise wrong(f"format {self.fmt}")
        if self.crop is not None and (min(self.crop[:2]) < 0 or min(self.crop[2:]) <= 0):
            raise wrong("crop")
        if self.scale is not None and (min(self.scale) < 0 or not any(self.scale)):
            raise wrong("scale")
        if self.chroma not in (0, 1, 2, 3):
            raise wrong("chroma mode")
        if self.animation not in (COMPOSITED, SUBFRAME):
            raise wrong("animation mode")
        if self.animation == SUBFRAME and (self.crop or self.scale or self.flip):
            raise wrong("frames on their own are not cropped, scaled or flipped")
        if self.limit < 0:
            raise wrong("limit")
        return self

    def fits(self, width: int, height: int) -> None:
        if self.limit and width * height > self.limit:
            raise CodecError(TOO_LARGE, f"{width} x {height} pixels")

    def without_filter(self, width: int, height: int) -> bool:
        """Pictures scaled below three quarters on both sides are decoded without the loop filter."""
        if self.bypass_filter:
            return True
        if self.scale is None:
            return False
        from tessellar.codecs.pixels import scaled_size

        source = self.crop[2:] if self.crop else (width, height)
        w, h = scaled_size(*source, *self.scale)
        return w < width * 3 // 4 and h < height * 3 // 4
