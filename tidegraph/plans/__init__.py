"""The two temporal models behind one interface, and parameter sweeps over their queries."""
