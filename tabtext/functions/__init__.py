"""Column functions: text (tokens, stop words) and scalars (softmax, logit, ...)."""

from .scalars import (absolute, argmax, as_double, int_range, logit, logit_array, reciprocal,  # noqa: F401
                      run_step, sign, softmax, square_root, squared_error)
from .text import (ENGLISH_STOP_WORDS, WORD_PATTERN, join_tokens, n_tokens, remove_stop,  # noqa: F401
                   strip_blanks, tokens)
