"""The document kernel: a tolerant LaTeX parser and the conversion of its nodes to Typst."""
