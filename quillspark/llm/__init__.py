"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; ``entries`` holds the registered queries."""
