"""Errors of the library; all share one root."""


class SpindriftError(Exception):
    """Anything that this library reports."""


class ConfigurationError(SpindriftError):
    """A pipeline file, template or setting can't be used."""


class SpecError(ConfigurationError):
    """A pipeline definition breaks a rule of its fields."""


class ExtractError(SpindriftError):
    """A source can't be read."""


class TransformError(SpindriftError):
    """A prompt can't be rendered or completed."""


class EvaluateError(SpindriftError):
    """A gate can't be built or decided."""


class GateError(EvaluateError):
    """A batch misses its minimum pass rate."""


class LoadError(SpindriftError):
    """A destination can't be written."""


class ConnectorError(SpindriftError):
    """A connector is unknown or can't be set up."""


class RetryableError(SpindriftError):
    """A failure that another attempt may mend."""


class DeadlineError(SpindriftError):
    """A call or stage took longer than it may."""


class RunError(SpindriftError):
    """A run broke off; its cause is chained."""
