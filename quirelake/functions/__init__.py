"""Scalar functions: text, arrays and geometry, all of them Spark expressions."""

from .arrays import argmax, clamp, softmax, top_probability
from .geometry import bbox_from_quad, fold_angle, line_direction, word_box
from .text import blank, page_number_like, strip, strip_suffix, text_features, words

__all__ = ["argmax", "bbox_from_quad", "blank", "clamp", "fold_angle", "line_direction", "page_number_like", "softmax", "strip", "strip_suffix", "text_features", "top_probability", "word_box", "words"]
