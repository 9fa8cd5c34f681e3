"""Table specifications: ordered fields with logical types, from which readers, coercions and checks are made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrisk.functions import scalar


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # int, double, text or month

    def column(self, source: Column) -> Column:
        how = {"int": scalar.to_int, "double": scalar.to_double, "text": scalar.to_text, "month": scalar.month_of_yyyymm}
        return how[self.kind](source).alias(self.name)


@dataclass(frozen=True)
class TableSpec:
    """Fields by position, and the key whose values must be unique."""

    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]

    def raw_schema(self) -> T.StructType:
        """All text, as header-less files are read, with a column for rows of another width."""
        return T.StructType([T.StructField(f.name, T.StringType()) for f in self.fields] + [T.StructField("_corrupt", T.StringType())])

    def canonical(self, raw: DataFrame) -> DataFrame:
        """Typed columns in one projection; what cannot be read is null."""
        return raw.select(*[f.column(F.col(f.name)) for f in self.fields])

    def differences(self, df: DataFrame) -> dict[str, list[str]]:
        own = [f.name for f in self.fields]
        return {"missing": [c for c in own if c not in df.columns], "unexpected": [c for c in df.columns if c not in own]}


def _fields(text: str) -> tuple[Field, ...]:
    return tuple(Field(*x.split(":")) for x in text.split())


# The positions, names and types of the two raw files.
ORIGINATION = TableSpec("origination", _fields(
    "credit_score:int first_payment_date:month first_time_homebuyer_flag:text maturity_date:month msa:text mi_percentage:int number_of_units:int occupancy_status:text "
    "original_cltv:int original_dti:int original_upb:int original_ltv:int original_interest_rate:double channel:text prepayment_penalty_flag:text amortization_type:text "
    "property_state:text property_type:text postal_code:text loan_id:text loan_purpose:text original_loan_term:int number_of_borrowers:int seller_name:text "
    "super_conforming_flag:text pre_harp_loan_id:text special_eligibility_program:text harp_indicator:text property_valuation_method:text interest_only_indicator:text vantage_score_4:int"
), ("loan_id",))
PERFORMANCE = TableSpec("performance", _fields(
    "loan_id:text period:month current_actual_upb:double current_loan_delinquency_status:text loan_age:int remaining_months_to_legal_maturity:int defect_settlement_date:month "
    "modification_flag:text zero_balance_code:text zero_balance_effective_date:month current_interest_rate:double current_non_interest_bearing_upb:double ddlpi:month "
    "mi_recoveries:double net_sales_proceeds:text non_mi_recoveries:double total_expenses:double legal_costs:double maintenance_preservation_costs:double taxes_and_insurance:double "
    "miscellaneous_expenses:double actual_loss:double cumulative_modification_costs:double interest_rate_step_indicator:text payment_deferral_flag:text estimated_ltv:int "
    "zero_balance_removal_upb:double delinquent_accrued_interest:double delinquency_due_to_disaster:text borrower_assistance_plan:text current_period_modification_costs:double "
    "current_interest_bearing_upb:double mi_cancellation_indicator:text servicer_name:text bankruptcy_cramdown_costs:double"
), ("loan_id", "period"))
