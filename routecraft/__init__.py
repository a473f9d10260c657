"""routecraft: route-cost features, cost matrices, scenario resolution and
shipment-plan optimisation expressed as Spark DataFrame / SQL plans."""

__version__ = "0.1.0"
