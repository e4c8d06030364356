"""A small repository: two sessions, a staging table between them, an unconnected lookup."""

GOLDEN = """
FOLDER{NAME=F}[
 SOURCE{NAME=SRC_A}[SOURCEFIELD{NAME=X} SOURCEFIELD{NAME=Y}]
 SOURCE{NAME=T1}[SOURCEFIELD{NAME=A} SOURCEFIELD{NAME=B}]
 TARGET{NAME=T1}[TARGETFIELD{NAME=A} TARGETFIELD{NAME=B}]
 TARGET{NAME=T2}[TARGETFIELD{NAME=A}]
 MAPPING{NAME=m1}[
  TRANSFORMATION{NAME=SQ_A;TYPE=Source Qualifier}[TRANSFORMFIELD{NAME=X;PORTTYPE=INPUT/OUTPUT} TRANSFORMFIELD{NAME=Y;PORTTYPE=INPUT/OUTPUT}]
  TRANSFORMATION{NAME=EXP_1;TYPE=Expression}[TRANSFORMFIELD{NAME=X;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=Y;PORTTYPE=INPUT}
    TRANSFORMFIELD{NAME=O_A;PORTTYPE=OUTPUT;EXPRESSION=IIF(X > 0, X, :LKP.LKP_C(Y))}]
  TRANSFORMATION{NAME=LKP_C;TYPE=Lookup Procedure}[TRANSFORMFIELD{NAME=IN_C;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=C_VAL;PORTTYPE=LOOKUP/RETURN/OUTPUT}
    TABLEATTRIBUTE{NAME=Lookup table name;VALUE=C_TBL}]
  INSTANCE{NAME=SRC_A;TYPE=SOURCE;TRANSFORMATION_NAME=SRC_A;TRANSFORMATION_TYPE=Source Definition}
  INSTANCE{NAME=SQ_A;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=SQ_A;TRANSFORMATION_TYPE=Source Qualifier}
  INSTANCE{NAME=EXP_1;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=EXP_1;TRANSFORMATION_TYPE=Expression}
  INSTANCE{NAME=LKP_C;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=LKP_C;TRANSFORMATION_TYPE=Lookup Procedure}
  INSTANCE{NAME=T1_TGT;TYPE=TARGET;TRANSFORMATION_NAME=T1;TRANSFORMATION_TYPE=Target Definition}
  CONNECTOR SRC_A.X(Source Definition) -> SQ_A.X
  CONNECTOR SRC_A.Y(Source Definition) -> SQ_A.Y
  CONNECTOR SQ_A.X(Source Qualifier) -> EXP_1.X
  CONNECTOR SQ_A.Y(Source Qualifier) -> EXP_1.Y
  CONNECTOR EXP_1.O_A(Expression) -> T1_TGT.A
  CONNECTOR SQ_A.Y(Source Qualifier) -> T1_TGT.B ]
 MAPPING{NAME=m2}[
  TRANSFORMATION{NAME=SQ_T1;TYPE=Source Qualifier}[TRANSFORMFIELD{NAME=A;PORTTYPE=INPUT/OUTPUT} TRANSFORMFIELD{NAME=B;PORTTYPE=INPUT/OUTPUT}]
  INSTANCE{NAME=T1_SRC;TYPE=SOURCE;TRANSFORMATION_NAME=T1}
  INSTANCE{NAME=SQ_T1;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=SQ_T1;TRANSFORMATION_TYPE=Source Qualifier}
  INSTANCE{NAME=T2_TGT;TYPE=TARGET;TRANSFORMATION_NAME=T2}
  CONNECTOR T1_SRC.A(Source Definition) -> SQ_T1.A
  CONNECTOR SQ_T1.A(Source Qualifier) -> T2_TGT.A ]
 WORKFLOW{NAME=WF}[
  TASKINSTANCE{NAME=Start;TASKTYPE=Start} TASKINSTANCE{NAME=s1;TASKTYPE=Session} TASKINSTANCE{NAME=s2;TASKTYPE=Session}
  SESSION{NAME=s1;MAPPINGNAME=m1} SESSION{NAME=s2;MAPPINGNAME=m2}
  WORKFLOWLINK{FROMTASK=Start;TOTASK=s1} WORKFLOWLINK{FROMTASK=s1;TOTASK=s2} ] ]
"""

#: A segment computed from a sum, a score and a region; a source that an earlier mapping's target feeds.
ENGINE_B = """
FOLDER{NAME=F}[
 SOURCE{NAME=ORD}[SOURCEFIELD{NAME=ORDER_VALUE} SOURCEFIELD{NAME=ADJUSTMENT} SOURCEFIELD{NAME=CREDIT_SCORE} SOURCEFIELD{NAME=REGION}]
 SOURCE{NAME=SEG}[SOURCEFIELD{NAME=CUSTOMER_SEGMENT}]
 TARGET{NAME=SEG}[TARGETFIELD{NAME=CUSTOMER_SEGMENT}]
 TARGET{NAME=REP}[TARGETFIELD{NAME=SEGMENT}]
 MAPPING{NAME=m1}[
  TRANSFORMATION{NAME=EXP_1;TYPE=Expression}[TRANSFORMFIELD{NAME=ORDER_VALUE;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=ADJUSTMENT;PORTTYPE=INPUT}
    TRANSFORMFIELD{NAME=SALES_AMT;PORTTYPE=OUTPUT;EXPRESSION=ORDER_VALUE + ADJUSTMENT}]
  TRANSFORMATION{NAME=EXP_2;TYPE=Expression}[TRANSFORMFIELD{NAME=SALES_AMT;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=CREDIT_SCORE;PORTTYPE=INPUT} TRANSFORMFIELD{NAME=REGION;PORTTYPE=INPUT}
    TRANSFORMFIELD{NAME=SEG_OUT;PORTTYPE=OUTPUT;EXPRESSION=IIF(SALES_AMT > 100000 AND CREDIT_SCORE > 750 AND REGION = 'US', 'PREMIUM', 'STANDARD')}]
  INSTANCE{NAME=ORD;TYPE=SOURCE;TRANSFORMATION_NAME=ORD;TRANSFORMATION_TYPE=Source Definition}
  INSTANCE{NAME=EXP_1;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=EXP_1;TRANSFORMATION_TYPE=Expression}
  INSTANCE{NAME=EXP_2;TYPE=TRANSFORMATION;TRANSFORMATION_NAME=EXP_2;TRANSFORMATION_TYPE=Expression}
  INSTANCE{NAME=SEG;TYPE=TARGET;TRANSFORMATION_NAME=SEG;TRANSFORMATION_TYPE=Target Definition}
  CONNECTOR ORD.ORDER_VALUE(Source Definition) -> EXP_1.ORDER_VALUE(Expression)
  CONNECTOR ORD.ADJUSTMENT(Source Definition) -> EXP_1.ADJUSTMENT(Expression)
  CONNECTOR EXP_1.SALES_AMT(Expression) -> EXP_2.SALES_AMT(Expression)
  CONNECTOR ORD.CREDIT_SCORE(Source Definition) -> EXP_2.CREDIT_SCORE(Expression)
  CONNECTOR ORD.REGION(Source Definition) -> EXP_2.REGION(Expression)
  CONNECTOR EXP_2.SEG_OUT(Expression) -> SEG.CUSTOMER_SEGMENT(Target Definition) ]
 MAPPING{NAME=m2}[
  INSTANCE{NAME=SEG;TYPE=SOURCE;TRANSFORMATION_NAME=SEG;TRANSFORMATION_TYPE=Source Definition}
  INSTANCE{NAME=REP;TYPE=TARGET;TRANSFORMATION_NAME=REP;TRANSFORMATION_TYPE=Target Definition}
  CONNECTOR SEG.CUSTOMER_SEGMENT(Source Definition) -> REP.SEGMENT(Target Definition) ]
 WORKFLOW{NAME=WF}[
  TASKINSTANCE{NAME=s1;TASKTYPE=Session} TASKINSTANCE{NAME=s2;TASKTYPE=Session}
  SESSION{NAME=s1;MAPPINGNAME=m1} SESSION{NAME=s2;MAPPINGNAME=m2}
  WORKFLOWLINK{FROMTASK=s1;TOTASK=s2} ] ]
"""
