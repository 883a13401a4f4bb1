"""wirefold: network-flow building, labelling, scoring and transfer evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
