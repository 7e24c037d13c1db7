"""Graph, layout and density operators."""
