"""Role to functional unit map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed: functional units and their roles; the order of units is the order of the vector.
ROLE_UNITS = {
    "unit_order": [
        "Administration",
        "Research and Engineering",
        "Manufacturing",
        "Finance",
        "Sales and Marketing",
        "Purchase and Contracting",
    ],
    "Administration": [
        "AdministrativeAssistant",
        "AdministrativeStaff",
        "Director",
        "Manager",
        "President",
        "VicePresident",
        "HumanResourceSpecialist",
        "ITAdmin",
        "ManagementTrainer",
        "InstructionalCoordinator",
        "SecurityGuard",
        "Attorney",
        "Nurse",
        "NursePractitioner",
    ],
    "Research and Engineering": [
        "ChiefEngineer",
        "ComputerProgrammer",
        "ComputerScientist",
        "ComputerTrainer",
        "ElectricalEngineer",
        "Engineer",
        "FieldServiceEngineer",
        "HardwareEngineer",
        "HealthSafetyEngineer",
        "IndustrialEngineer",
        "MaterialsEngineer",
        "Mathematician",
        "MechanicalEngineer",
        "Physicist",
        "Scientist",
        "SoftwareEngineer",
        "Statistician",
        "SystemsEngineer",
        "TechnicalTrainer",
        "TestEngineer",
    ],
    "Manufacturing": ["AssemblySupervisor", "ProductionLineWorker", "LabManager", "Technician"],
    "Finance": ["Accountant", "FinancialAnalyst"],
    "Sales and Marketing": ["Salesman"],
    "Purchase and Contracting": ["PurchasingClerk"],
}


@dataclass(frozen=True)
class RoleMap:
    unit_order: list[str]
    role_to_unit: dict[str, str]
    default_unit: str | None = None


def role_map(mapping: dict | None = None) -> RoleMap:
    """Check a mapping (``unit_order``, optional ``default_unit``, unit -> roles)."""
    data = ROLE_UNITS if mapping is None else mapping
    if not data:
        raise ValueError("role mapping is empty")
    units = data.get("unit_order")
    if not units:
        raise ValueError("role mapping needs a non-empty 'unit_order'")
    pairs: dict[str, str] = {}
    for unit in units:
        roles = data.get(unit)
        if roles is not None:
            listed = roles if isinstance(roles, list) else [roles]
            pairs.update((str(role).strip(), unit) for role in listed)
    return RoleMap(list(units), pairs, data.get("default_unit"))


def load_role_map(path: str) -> RoleMap:
    """Role map from a YAML file (needs PyYAML) or a JSON file."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            import json

            return role_map(json.load(handle) or {})
        import yaml

        return role_map(yaml.safe_load(handle) or {})


def role_units(spark: SparkSession, mapping: RoleMap | None = None) -> DataFrame:
    """(role, unit, idx) rows."""
    known = mapping or role_map()
    rows = [(role, unit, known.unit_order.index(unit)) for role, unit in known.role_to_unit.items()]
    return spark.createDataFrame(rows, "role string, unit string, idx int")
