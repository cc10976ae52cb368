"""DuckDB text of the fixture views, used by the oracle statements."""


def r6(x: str) -> str:
    return f"(floor(({x})*1e6+0.5001)/1e6)"


def grad(v: str, axis: str) -> str:
    last = {"r": "rmax", "c": "cmax"}[axis]
    p, n = f"p_{v}_{axis}", f"n_{v}_{axis}"
    return (f"CASE WHEN {axis}=0 THEN ({n}-{v})/30e0 WHEN {axis}={last} THEN ({v}-{p})/30e0 ELSE ({n}-{p})/60e0 END")


def around(v: str, axis: str) -> str:
    other = "c" if axis == "r" else "r"
    return (f"lag({v}) OVER (PARTITION BY {other} ORDER BY {axis}) AS p_{v}_{axis}, "
            f"lead({v}) OVER (PARTITION BY {other} ORDER BY {axis}) AS n_{v}_{axis}")


RHO = "({}*2.75e-5+(-2e-1))"
WEIGHT = "(1e0/(1e0+exp(-least(greatest(({k}e0)*(cos_i-1e-1),-700e0),700e0))))"
STRATUM = ("CASE WHEN cos_i IS NULL THEN NULL WHEN cos_i<=0 THEN 'self_shadow' WHEN cos_i<=1e-1 THEN 'near_zero' "
           "WHEN cos_i<=4e-1 THEN 'mu_band_low' WHEN cos_i<=7e-1 THEN 'mu_band_mid' ELSE 'mu_band_high' END")

VIEWS = {
    "dem": """SELECT p_partkey//50 AS r, p_partkey%50 AS c,
        CASE WHEN p_size<>50 THEN p_retailprice+p_size END AS z, p_retailprice+p_size AS zf, p_size FROM part""",
    "demv2": "SELECT r, c, CASE WHEN r BETWEEN 1 AND 2 AND c BETWEEN 20 AND 22 THEN z+1 ELSE z END AS z FROM dem",
    "ext": "SELECT max(r) AS rmax, max(c) AS cmax FROM dem",
    "grad1": f"""SELECT r, c, z, rmax, cmax, {grad('z','r')} AS dr, {grad('z','c')} AS dc
        FROM (SELECT r, c, z, rmax, cmax, {around('z','r')}, {around('z','c')} FROM dem, ext)""",
    "grad2": f"""SELECT r, c, z, dr, dc, {grad('dr','r')} AS d2r, {grad('dc','c')} AS d2c
        FROM (SELECT *, {around('dr','r')}, {around('dc','c')} FROM grad1)""",
    "terr0": """SELECT r, c, z, dr, dc, d2r+d2c AS k, degrees(atan(sqrt(dc*dc+dr*dr))) AS s,
        (degrees(atan2(-dc, dr))+360e0) % 360e0 AS a0 FROM grad2""",
    "terr1": """SELECT r, c, z, dr, dc, k, s, CASE WHEN s<1e-8 THEN 0e0 ELSE a0 END AS a,
        (z IS NOT NULL AND s IS NOT NULL AND a0 IS NOT NULL AND k IS NOT NULL) AS ok FROM terr0""",
    "terrain": """SELECT r, c, z, dr, dc, CASE WHEN ok THEN s END AS slope, CASE WHEN ok THEN a END AS aspect,
        CASE WHEN ok THEN k END AS curvature,
        CASE WHEN ok THEN least(greatest(255e0*(sin(radians(45e0))*cos(radians(s))+cos(radians(45e0))*sin(radians(s))
            *cos(radians(90e0-315e0)-radians(90e0-a))),0e0),255e0) END AS hillshade, ok AS terrain_valid FROM terr1""",
    "acq": """SELECT a, cents, n_scene, 90+(cents%18000)/1e2 AS sun_az, 15+(cents%3000)/1e2 AS sun_el,
        DATE '2013-01-01' + (cents%4000)::INT AS day FROM (SELECT s_nationkey AS a,
        sum(round(abs(s_acctbal)*100)::BIGINT)::BIGINT AS cents, count(*) AS n_scene FROM supplier GROUP BY 1)""",
    "scene": """SELECT scene_id, a, cents, DATE '2013-01-01' + (cents%4000)::INT AS day, a%4+128 AS wrs_path,
        a%3+36 AS wrs_row, CASE WHEN cents%97<>0 THEN (cents%101)/1e0 END AS cloud,
        CASE WHEN cents%89<>0 THEN 90+(cents%18000)/1e2 END AS sun_az,
        CASE WHEN cents%83<>0 THEN 15+(cents%3000)/1e2 END AS sun_el,
        cents%60-40 AS x0, cents%45-30 AS y0, cents%60-40+1490+cents%80 AS x1, cents%45-30+1200+cents%55 AS y1
        FROM (SELECT s_name AS scene_id, s_nationkey AS a, round(abs(s_acctbal)*100)::BIGINT AS cents FROM supplier)""",
    "obs": """SELECT a, r, c, CASE WHEN v4=1 THEN floor(5000+l_extendedprice/2.7e0)::BIGINT ELSE 0 END AS dn4,
        CASE WHEN v5=1 THEN (l_quantity*760+5000)::BIGINT ELSE 0 END AS dn5,
        CASE round(l_discount*100)::INT WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 32
        WHEN 5 THEN 128 ELSE 64 END AS qa, v4, v5, 1 AS vqa
        FROM (SELECT *, CASE WHEN l_linenumber=7 THEN 0 ELSE 1 END AS v4,
          CASE WHEN l_linenumber=6 AND l_tax>6.5e-2 THEN 0 ELSE 1 END AS v5,
          row_number() OVER (PARTITION BY a, r, c ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey,
            l_extendedprice, l_quantity, l_discount, l_tax) AS rn
          FROM (SELECT *, s_nationkey AS a, l_partkey//50 AS r, l_partkey%50 AS c FROM lineitem
                JOIN supplier ON l_suppkey=s_suppkey)) WHERE rn=1""",
    "px0": f"""SELECT o.*, {RHO.format('dn4')} AS rho4, {RHO.format('dn5')} AS rho5, t.z, t.slope, t.aspect,
        coalesce(t.terrain_valid, false) AS tvalid, sun_az, sun_el,
        (cos(radians(slope))*cos(radians(90e0-sun_el))+sin(radians(slope))*sin(radians(90e0-sun_el))
          *cos(radians(sun_az-aspect)))::FLOAT::DOUBLE AS cos_i,
        (v4=1 AND v5=1 AND vqa=1) AS msource, (qa & 63)=0 AS clear, ((qa>>7)&1)=1 AS water
        FROM obs o LEFT JOIN terrain t ON o.r=t.r AND o.c=t.c JOIN acq ON o.a=acq.a""",
    "px": """SELECT *, base AND NOT water AS land FROM (SELECT *, msource AND clear AND inrange AND tvalid AS base FROM (
        SELECT *, (rho4 BETWEEN -5e-2 AND 1e0 AND rho5 BETWEEN -5e-2 AND 1e0) AS inrange,
        CASE WHEN cos_i IS NOT NULL THEN greatest(cos_i, 0e0) END AS mu, coalesce(cos_i>1e-1, false) AS lit FROM px0))""",
    "fold": "SELECT k, (k-1)*10 AS c0, (k-1)*10+4 AS c1 FROM range(1,6) t(k)",
    "band": "SELECT unnest(['B4','B5']) AS band",
    "role": """SELECT px.*, k, CASE WHEN c BETWEEN c0 AND c1 THEN 'core'
        WHEN greatest(c0-c, c-c1) < 3 THEN 'buffer' ELSE 'domain' END AS role FROM px, fold""",
    "rb": "SELECT role.*, band, CASE WHEN band='B4' THEN rho4 ELSE rho5 END AS rho FROM role, band",
    "fit": """SELECT a, k, band, count(*) FILTER (WHERE cal) AS n_cal, coalesce(sum(mu*rho) FILTER (WHERE cal),0e0) AS num,
        coalesce(sum(mu*mu) FILTER (WHERE cal),0e0) AS den FROM (SELECT *, land AND lit AND role='domain' AS cal FROM rb)
        GROUP BY a, k, band""",
    "alpha": """SELECT *, CASE WHEN n_cal<20 OR den<=0 THEN NULL ELSE least(greatest(num/den,0e0),1e0) END AS alpha,
        CASE WHEN n_cal<20 THEN 'calibration_support_below_minimum' WHEN den<=0 THEN 'nonpositive_mu_squared_denominator' END AS reason FROM fit""",
    "resid": """SELECT rb.a, rb.k, rb.band, rb.r, rb.c, cos_i, mu, rho, rho4, rho5, alpha*mu-rho AS e,
        (1::FLOAT - cos_i::FLOAT)::FLOAT AS score
        FROM rb JOIN alpha USING (a, k, band) WHERE role='core' AND land AND lit AND alpha IS NOT NULL""",
    "split": """SELECT a, day, rn, n, CASE WHEN n<3 THEN 'none' WHEN rn<=greatest(floor(n*6e-1),1) THEN 'train'
        WHEN rn<=greatest(floor(n*6e-1),1)+greatest(floor(n*2e-1),1) THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT a, day, row_number() OVER (ORDER BY day, a) AS rn, count(*) OVER () AS n FROM acq)""",
    "corecnt": """SELECT a, k, count(*) AS core_total, count(*) FILTER (WHERE land) AS core_land,
        count(*) FILTER (WHERE lit) AS core_geometry, count(*) FILTER (WHERE land AND lit) AS core_scored
        FROM role WHERE role='core' GROUP BY a, k""",
    "unit": """SELECT u.a, u.k, u.band, s.split, coalesce(n_cal,0) AS n_cal, alpha,
        CASE WHEN alpha IS NULL THEN 'unsupported_calibration' ELSE 'fitted' END AS state,
        CASE WHEN n_cal IS NULL THEN 'calibration_support_below_minimum' ELSE reason END AS reason,
        coalesce(core_total,0) AS core_total, coalesce(core_land,0) AS core_land,
        coalesce(core_geometry,0) AS core_geometry, coalesce(core_scored,0) AS core_scored,
        CASE WHEN core_land>0 THEN core_scored::DOUBLE/core_land END AS coverage, bias, mae, med, p90, n_res
        FROM (SELECT a, k, band FROM acq, fold, band) u JOIN split s USING (a) LEFT JOIN alpha USING (a,k,band)
        LEFT JOIN corecnt USING (a,k) LEFT JOIN (SELECT a, k, band, count(*) AS n_res, avg(e) AS bias, avg(abs(e)) AS mae,
          quantile_cont(abs(e),0.5) AS med, quantile_cont(abs(e),0.9) AS p90 FROM resid GROUP BY a,k,band) USING (a,k,band)""",
    "journal": """SELECT event_id AS seq, ts, user_id AS task_id, CASE event_type WHEN 'signup' THEN 'READY'
        WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
        WHEN 'click' THEN 'CANCELLED' END AS state, event_id%3+1 AS attempt FROM events""",
    "dday": """SELECT c_nationkey AS d, o_orderdate::DATE AS day, CASE WHEN count(*) FILTER (WHERE o_orderstatus='O')<count(*)
        THEN (sum(CASE WHEN o_orderstatus='F' THEN ct ELSE 0 END)::DOUBLE)/(sum(ct)::DOUBLE) END AS coverage, count(*) AS scenes
        FROM (SELECT *, round(o_totalprice*100)::BIGINT AS ct FROM orders) JOIN customer ON o_custkey=c_custkey GROUP BY 1,2""",
    "refday": """SELECT DISTINCT s_nationkey AS d, l_shipdate::DATE AS day FROM lineitem JOIN supplier ON l_suppkey=s_suppkey
        WHERE l_returnflag='R' AND l_quantity>45""",
    "dclass": "SELECT c_nationkey AS d, c_mktsegment AS class, count(*) AS n FROM customer GROUP BY 1,2",
    "zmask": "SELECT r, c, CASE WHEN p_size>35 THEN 1 ELSE 0 END AS m FROM dem",
    "artifact": "SELECT doc_id AS id, source AS role, text FROM documents",
    "mrow": """SELECT vec_id, label, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2,
        embedding[1]::DOUBLE+embedding[2]::DOUBLE AS x3, embedding[3]::DOUBLE AS y FROM embeddings""",
    "sightd": "SELECT unnest([30e0,60e0,90e0,120e0,150e0]) AS dist",
    "sight": """SELECT r AS pr, c AS pc, zf AS z0, az, dist, least(greatest(r-dist*cos(az)/30e0,0e0),rmax) AS y,
        least(greatest(c+dist*sin(az)/30e0,0e0),cmax) AS x, rmax, cmax
        FROM dem, ext, (SELECT i*(2*pi()/8) AS az FROM range(0,8) t(i)), sightd""",
    "sightz": """SELECT pr, pc, az, dist, any_value(z0) AS z0, sum(w*zf) AS zz, bool_and(zf IS NOT NULL) AS full_line FROM
        (SELECT s.*, least(floor(y)+i, rmax) AS r, least(floor(x)+j, cmax) AS c,
          (CASE WHEN i=1 THEN y-floor(y) ELSE 1-(y-floor(y)) END)*(CASE WHEN j=1 THEN x-floor(x) ELSE 1-(x-floor(x)) END) AS w
         FROM sight s, (VALUES (0,0),(0,1),(1,0),(1,1)) q(i,j)) k LEFT JOIN dem USING (r,c) WHERE w>0 GROUP BY pr,pc,az,dist""",
    "vsky": """SELECT pr AS r, pc AS c, avg(1e0/(1e0+t*t)) AS v_sky FROM (SELECT pr, pc, az, greatest(max((zz-z0)/dist),0e0) AS t
        FROM sightz GROUP BY pr,pc,az) GROUP BY pr,pc""",
    "vrole": "SELECT role.*, v_sky FROM role JOIN vsky USING (r,c)",
    "gram": """SELECT a, k, band, count(*)::DOUBLE AS n, sum(mu) AS m, sum(mu*mu) AS mm, sum(mu*v_sky) AS mv, sum(v_sky) AS v,
        sum(v_sky*v_sky) AS vv, sum(mu*rho) AS my, sum(rho) AS y, sum(v_sky*rho) AS vy,
        quantile_cont(v_sky,0.75)-quantile_cont(v_sky,0.25) AS iqr
        FROM (SELECT vrole.*, band, CASE WHEN band='B4' THEN rho4 ELSE rho5 END AS rho FROM vrole, band)
        WHERE land AND lit AND role='domain' GROUP BY a,k,band""",
    "cand0": """SELECT a,k,band,n,iqr,mm,'C0' AS candidate, mm AS g11, 0e0 AS g12, mm AS g22, my AS b1, 0e0 AS b2 FROM gram
        UNION ALL SELECT a,k,band,n,iqr,mm,'C1p', mm, m, n, my, y FROM gram
        UNION ALL SELECT a,k,band,n,iqr,mm,'C1', mm, mv, vv, my, vy FROM gram
        UNION ALL SELECT a,k,band,n,iqr,mm,'C2a', mm, m-mv, n-2*v+vv, my, y-vy FROM gram""",
    "cand1": """SELECT *, (g11+g22)/2+sqrt(pow((g11-g22)/2,2)+g12*g12) AS big, g11*g22-g12*g12 AS det FROM cand0""",
    "cfit": """SELECT a,k,band,n,iqr,candidate, CASE WHEN n<20 THEN 'calibration_support_below_minimum' WHEN mm<=0 THEN 'nonpositive_mu_squared_denominator'
        WHEN candidate<>'C0' AND iqr<5e-2 THEN 'insufficient_v_sky_variation'
        WHEN candidate<>'C0' AND NOT (sqrt(greatest(det,0)/big) > sqrt(big)*1e-10) THEN 'singular_design_matrix' END AS reason,
        CASE WHEN candidate='C0' THEN b1/mm WHEN det>0 THEN (g22*b1-g12*b2)/det END AS t1,
        CASE WHEN candidate<>'C0' AND det>0 THEN (g11*b2-g12*b1)/det END AS t2,
        CASE WHEN candidate='C0' THEN 1e0 WHEN det>0 THEN sqrt(big/(greatest(det,0)/big)) END AS cond FROM cand1""",
    "cres": """SELECT x.a,x.k,x.band,candidate, t1*mu+coalesce(t2,0e0)*(CASE candidate WHEN 'C1p' THEN 1e0 WHEN 'C1' THEN v_sky
        WHEN 'C2a' THEN 1-v_sky ELSE 0e0 END)-rho AS e FROM (SELECT vrole.*, band, CASE WHEN band='B4' THEN rho4 ELSE rho5 END AS rho
        FROM vrole, band WHERE role='core' AND land AND lit) x JOIN cfit f ON x.a=f.a AND x.k=f.k AND x.band=f.band AND f.reason IS NULL""",
    "abl": """SELECT u.*, coalesce(n,0)::BIGINT AS n, coalesce(core_land,0) AS core_land, f.candidate IS NOT NULL AS has_fit, t1, t2, cond,
        CASE WHEN f.a IS NULL THEN 'calibration_support_below_minimum' WHEN f.reason IS NOT NULL THEN f.reason WHEN cnt IS NULL THEN 'no_supported_pixel_in_core' END AS reason,
        CASE WHEN f.a IS NULL OR f.reason IS NOT NULL THEN 'unsupported' WHEN cnt IS NULL THEN 'not_scored' ELSE 'scored' END AS state,
        cnt, bias, mae, p90, CASE WHEN core_land>0 THEN cnt::DOUBLE/core_land END AS coverage
        FROM (SELECT a, k, band, split, unnest(['C0','C1p','C1','C2a']) AS candidate FROM split, fold, band) u
        LEFT JOIN cfit f USING (a,k,band,candidate) LEFT JOIN corecnt USING (a,k)
        LEFT JOIN (SELECT a,k,band,candidate,count(*) AS cnt,avg(e) AS bias,avg(abs(e)) AS mae,quantile_cont(abs(e),0.9) AS p90 FROM cres GROUP BY 1,2,3,4) s
        USING (a,k,band,candidate)""",
    "pairs": """SELECT x.*, b.mae AS mae_base, b.coverage AS coverage_base, b.t1 AS alpha_base,
        abs(coalesce(x.coverage,0e0)-coalesce(b.coverage,0e0))<=1e-3 AS comparable, CASE WHEN b.mae>0 THEN (b.mae-x.mae)/b.mae END AS improvement
        FROM abl x JOIN abl b USING (a,k,band) WHERE x.candidate<>'C0' AND b.candidate='C0' AND x.state='scored' AND b.state='scored'""",
    "train": "SELECT * FROM pairs WHERE split='train' AND comparable AND improvement IS NOT NULL",
    "msum": """SELECT a,k,band,count(*)::DOUBLE AS n, count(*) FILTER (WHERE lit)::DOUBLE AS nl, sum(mu) AS sx, sum(mu*mu) AS sxx, sum(rho) AS sy,
        sum(mu*rho) AS sxy, sum(rho*rho) AS syy, sum(CASE WHEN lit THEN mu*mu ELSE 0e0 END) AS hxx, sum(CASE WHEN lit THEN mu*rho ELSE 0e0 END) AS hxy,
        sum(CASE WHEN lit THEN rho*rho ELSE 0e0 END) AS hyy, """ + ", ".join(f"sum({WEIGHT.format(k=k)}*mu*mu) AS w{k}xx, sum({WEIGHT.format(k=k)}*mu*rho) AS w{k}xy, "
        f"sum({WEIGHT.format(k=k)}*rho*rho) AS w{k}yy" for k in (15, 30, 60)) + """ FROM rb WHERE land AND role='domain' GROUP BY a,k,band""",
    "msl": """SELECT *, CASE WHEN nn>0 AND xx>0 THEN least(greatest(xy/xx,0e0),1e0) END AS alpha FROM (
        SELECT a,k,band,'hard_mask' AS method, nl AS nn, hxy AS xy, hxx AS xx, hyy AS yy FROM msum
        UNION ALL SELECT a,k,band,'soft_weight_k15',n,w15xy,w15xx,w15yy FROM msum UNION ALL SELECT a,k,band,'soft_weight_k30',n,w30xy,w30xx,w30yy FROM msum
        UNION ALL SELECT a,k,band,'soft_weight_k60',n,w60xy,w60xx,w60yy FROM msum)""",
    "dcand": """SELECT a,k,band,n,sx,sy,sxx,sxy,syy, 0 AS rk, CASE WHEN sxx*n-sx*sx>1e-12 THEN (sxy*n-sx*sy)/(sxx*n-sx*sx) END AS al,
          CASE WHEN sxx*n-sx*sx>1e-12 THEN (sxx*sy-sx*sxy)/(sxx*n-sx*sx) END AS d FROM msum
        UNION ALL SELECT a,k,band,n,sx,sy,sxx,sxy,syy,1,CASE WHEN sxx>0 THEN sxy/sxx END,CASE WHEN sxx>0 THEN 0e0 END FROM msum
        UNION ALL SELECT a,k,band,n,sx,sy,sxx,sxy,syy,2,u,1e-1*u FROM (SELECT *, least(greatest((sxy+1e-1*sy)/(sxx+2*1e-1*sx+1e-1*1e-1*n),0e0),1e0) AS u FROM msum)
        UNION ALL SELECT a,k,band,n,sx,sy,sxx,sxy,syy,3,1e0,least(greatest((sy-sx)/n,0e0),1e-1) FROM msum
        UNION ALL SELECT a,k,band,n,sx,sy,sxx,sxy,syy,4,0e0,0e0 FROM msum""",
    "dbest": """SELECT a,k,band,n,al,d,obj FROM (SELECT *, row_number() OVER (PARTITION BY a,k,band ORDER BY obj, rk) AS rn FROM (
        SELECT a,k,band,n,rk,al,d, al*al*sxx+2*al*d*sx-2*al*sxy+d*d*n-2*d*sy+syy AS obj FROM (SELECT * REPLACE (least(greatest(al,0e0),1e0) AS al, greatest(d,0e0) AS d)
        FROM dcand WHERE al>=-1e-12 AND al<=1+1e-12 AND d>=-1e-12 AND d<=1e-1*al+1e-12))) WHERE rn=1""",
    "mfit": """SELECT a,k,band,method,alpha,0e0 AS d,nn::BIGINT AS n_cal,alpha*alpha*xx-2*alpha*xy+yy AS objective,false AS boundary_hit FROM msl
        UNION ALL SELECT a,k,band,'bounded_scene_constant_diffuse',al,d,n::BIGINT,obj,dl<=1e-12 OR dl>=1e-1-1e-12 FROM
        (SELECT *, CASE WHEN al<=1e-12 THEN 0e0 ELSE least(greatest(d/al,0e0),1e-1) END AS dl FROM dbest)""",
    "mres": """SELECT rb.a,rb.k,rb.band,method,r,c,cos_i,lit,rho,rho4,rho5,CASE WHEN cos_i<=0 THEN 'shadow' WHEN cos_i<=1e-1 THEN 'near_zero' ELSE 'lit' END AS part,
        CASE WHEN method<>'hard_mask' OR lit THEN alpha*mu+d-rho END AS e,
        CASE WHEN method='hard_mask' THEN (CASE WHEN lit THEN 1e0 END) ELSE """ + WEIGHT.format(k=30) + """ END AS rel
        FROM rb JOIN mfit f ON rb.a=f.a AND rb.k=f.k AND rb.band=f.band WHERE role='core' AND land""",
    "scoped": "SELECT resid.*, unnest(['unit_all_scored', " + STRATUM + "]) AS scope FROM resid",
    "pts": """SELECT a,k,band,scope,score,point,accepted,scored,points,core_land AS den,accepted::DOUBLE/core_land AS coverage,ss/accepted AS mae FROM (
        SELECT a,k,band,scope,score,row_number() OVER w AS point, (sum(n) OVER w)::BIGINT AS accepted, sum(s) OVER w AS ss,
          (sum(n) OVER (PARTITION BY a,k,band,scope))::BIGINT AS scored, count(*) OVER (PARTITION BY a,k,band,scope) AS points
        FROM (SELECT a,k,band,scope,score,count(*) AS n,sum(abs(e)) AS s FROM scoped GROUP BY 1,2,3,4,5)
        WINDOW w AS (PARTITION BY a,k,band,scope ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) JOIN corecnt USING (a,k)""",
    "adm": "SELECT * FROM pts WHERE accepted>=5",
    "gridm": """SELECT g.a,g.k,g.band,g.scope,q,den,top,max(p.point) AS pt FROM (SELECT a,k,band,scope,any_value(den) AS den,max(accepted) AS top FROM adm GROUP BY 1,2,3,4) g
        CROSS JOIN (SELECT * FROM range(1,21) t(q)) LEFT JOIN (SELECT a,k,band,scope,point,accepted FROM adm) p
        ON p.a=g.a AND p.k=g.k AND p.band=g.band AND p.scope=g.scope AND 20*p.accepted<=q*den GROUP BY 1,2,3,4,5,6,7""",
    "gridr": """SELECT a,k,band,scope,q,status,reason,pt AS point,coverage,mae,accepted,CASE WHEN pt IS NOT NULL THEN first_q/20e0 END AS canonical FROM (
        SELECT m.*, CASE WHEN pt IS NULL THEN 'unreachable' WHEN q=first_q THEN 'reachable' ELSE 'duplicate' END AS status,
          CASE WHEN raw IS NULL THEN 'below_min_accepted_support' WHEN above THEN 'above_max_reachable_coverage' WHEN q<>first_q THEN 'duplicate_exact_point' END AS reason
        FROM (SELECT *, min(q) OVER (PARTITION BY a,k,band,scope,pt) AS first_q FROM (SELECT a,k,band,scope,q,pt AS raw,q*den>20*top AS above,
          CASE WHEN q*den>20*top THEN NULL ELSE pt END AS pt FROM gridm)) m)
        LEFT JOIN (SELECT a,k,band,scope,point AS pt,coverage,mae,accepted FROM adm) USING (a,k,band,scope,pt)""",
    "aurc": """SELECT a,k,band,scope,CASE WHEN n>=2 THEN area END AS area,CASE WHEN n>=2 THEN span END AS span,CASE WHEN n>=2 AND span>0 THEN area/span END AS normalized FROM (
        SELECT a,k,band,scope,count(*) AS n,sum(mae*(nxt-coverage)) AS area,max(coverage)-min(coverage) AS span FROM
        (SELECT *, lead(coverage) OVER (PARTITION BY a,k,band,scope ORDER BY point) AS nxt FROM adm) GROUP BY 1,2,3,4)""",
    "shape": """SELECT a,k,band,scope,count(*) AS reachable,CASE WHEN bool_or(up) AND bool_or(dn) THEN 'mixed' WHEN bool_or(up) THEN 'order_consistent'
        WHEN bool_or(dn) THEN 'order_inverted' ELSE 'flat' END AS shape FROM (SELECT *, coalesce(mae-p>1e-12+1e-12*greatest(abs(mae),abs(p)),false) AS up,
        coalesce(mae-p<-(1e-12+1e-12*greatest(abs(mae),abs(p))),false) AS dn FROM (SELECT *, lag(mae) OVER (PARTITION BY a,k,band,scope ORDER BY q) AS p FROM gridr WHERE status='reachable')) GROUP BY 1,2,3,4""",
    "scopeval": """SELECT *, CASE WHEN reason IS NULL THEN 'evaluated' ELSE 'not_evaluable' END AS gate, CASE WHEN reason IN ('unit_gate_not_scored',
        'zero_base_valid_land_denominator','zero_scored_denominator','N_scored_below_20') THEN 'not_evaluable_insufficient_scored_support'
        WHEN reason IS NOT NULL THEN 'not_evaluable_score_degenerate' WHEN shape='order_consistent' THEN 'descriptive_ordering_signal' WHEN shape='order_inverted' THEN 'directionally_adverse'
        ELSE 'descriptive_non_discriminative' END AS verdict FROM (
        SELECT u.a,u.k,u.band,scope,split,coalesce(scored,0) AS n_scored,s_min,s_max,exact_points,admissible_points,area,span,normalized,shape,
        CASE WHEN NOT (alpha IS NOT NULL AND core_scored>0) THEN 'unit_gate_not_scored' WHEN core_land=0 THEN 'zero_base_valid_land_denominator'
        WHEN scored IS NULL THEN 'zero_scored_denominator' WHEN scored<20 THEN 'N_scored_below_20'
        WHEN s_max-s_min<=1e-12+1e-12*greatest(abs(s_min),abs(s_max)) THEN 'score_range_at_or_below_tau_score'
        WHEN coalesce(exact_points,0)<3 THEN 'unique_proxy_values_below_3' WHEN coalesce(admissible_points,0)<3 THEN 'admissible_exact_points_below_3'
        WHEN coalesce(reachable,0)<3 THEN 'canonical_reachable_grid_points_below_3' WHEN coalesce(span,0)<=0 THEN 'AURC_nonpositive_span' END AS reason
        FROM (SELECT *, unnest(['unit_all_scored','mu_band_low','mu_band_mid','mu_band_high']) AS scope FROM unit) u
        LEFT JOIN (SELECT a,k,band,scope,max(scored) AS scored,min(score)::DOUBLE AS s_min,max(score)::DOUBLE AS s_max,max(points) AS exact_points,
          count(*) FILTER (WHERE accepted>=5) AS admissible_points FROM pts GROUP BY 1,2,3,4) USING (a,k,band,scope)
        LEFT JOIN aurc USING (a,k,band,scope) LEFT JOIN shape USING (a,k,band,scope))""",
    "main3": "SELECT * FROM mres WHERE method IN ('hard_mask','soft_weight_k30','bounded_scene_constant_diffuse')",
    "defs": """SELECT *, def, CASE WHEN def='ndvi' THEN (CASE WHEN abs(rho5+rho4)>1e-6 THEN (rho5-rho4)/(rho5+rho4) END) ELSE (rho4+rho5)/2 END AS dv
        FROM role, (SELECT unnest(['ndvi','brightness']) AS def)""",
    "cuts": """SELECT a,k,def,quantile_cont(dv,0.25) AS t1,quantile_cont(dv,0.5) AS t2,quantile_cont(dv,0.75) AS t3 FROM defs
        WHERE land AND role='domain' AND dv IS NOT NULL GROUP BY 1,2,3""",
    "strat": """SELECT m.a,m.k,m.band,m.def,method,e,CASE WHEN dv<=t1 THEN 'q1' WHEN dv<=t2 THEN 'q2' WHEN dv<=t3 THEN 'q3' ELSE 'q4' END AS stratum FROM (
        SELECT main3.*, def, CASE WHEN def='ndvi' THEN (CASE WHEN abs(rho5+rho4)>1e-6 THEN (rho5-rho4)/(rho5+rho4) END) ELSE (rho4+rho5)/2 END AS dv
        FROM main3, (SELECT unnest(['ndvi','brightness']) AS def) WHERE lit) m JOIN cuts c ON m.a=c.a AND m.k=c.k AND m.def=c.def WHERE dv IS NOT NULL""",
    "smet": """SELECT a,k,band,def,stratum,method,count(*) AS n,avg(abs(e)) AS mae,quantile_cont(abs(e),0.9) AS p90 FROM
        (SELECT * REPLACE (unnest(['global', stratum]) AS stratum) FROM strat) GROUP BY 1,2,3,4,5,6""",
    "fullpx": """SELECT acq.a, dem.r, dem.c, px.a IS NOT NULL AS seen, px.cos_i, coalesce(px.msource, false) AS msource, coalesce(px.clear, false) AS clear, coalesce(px.inrange, false) AS inrange, coalesce(px.water, false) AS water, coalesce(px.tvalid, false) AS tvalid, coalesce(px.base, false) AS base, coalesce(px.land, false) AS land, coalesce(px.lit, false) AS lit
        FROM acq CROSS JOIN dem LEFT JOIN px ON px.a=acq.a AND px.r=dem.r AND px.c=dem.c""",
    "cls": """SELECT r, c, (p_size<=35)::INT AS land, (p_size<=5)::INT AS shadow, (p_size BETWEEN 6 AND 10)::INT AS near_zero, (p_size BETWEEN 11 AND 35)::INT AS lit FROM dem""",
    "core0": """SELECT r AS r0, c AS c0, e AS edge, r+e AS r1, c+e AS c1 FROM (SELECT unnest(range(0, rmax+1)) AS r FROM ext) rr, (SELECT unnest(range(0, cmax+1)) AS c FROM ext) cc, ext, (SELECT unnest([6,10]) AS e)
        WHERE r+e<=rmax+1 AND c+e<=cmax+1 AND (r%4=0 OR r=rmax+1-e) AND (c%4=0 OR c=cmax+1-e)""",
    "cdist": """SELECT r0,c0,edge,r,c,land,shadow,near_zero,lit,sqrt(pow(greatest(r0-r,r-(r1-1),0),2)+pow(greatest(c0-c,c-(c1-1),0),2)) AS dist FROM core0, cls""",
    "cand": """SELECT r0,c0,edge, sum(CASE WHEN dist=0 THEN land ELSE 0 END)::BIGINT AS holdout_land, sum(CASE WHEN dist<5 THEN land ELSE 0 END)::BIGINT AS near_land,
        sum(CASE WHEN dist>=5 THEN land ELSE 0 END)::BIGINT AS calibration_land, sum(CASE WHEN dist=0 THEN shadow ELSE 0 END)::BIGINT AS holdout_shadow,
        sum(CASE WHEN dist=0 THEN near_zero ELSE 0 END)::BIGINT AS holdout_near_zero, sum(CASE WHEN dist=0 THEN lit ELSE 0 END)::BIGINT AS holdout_lit,
        sum(CASE WHEN dist>=5 THEN shadow ELSE 0 END)::BIGINT AS calibration_shadow, min(CASE WHEN dist>=5 AND land=1 THEN dist END) AS nearest_outside FROM cdist GROUP BY 1,2,3""",
    "kinds": "SELECT unnest(['clean','shadow','near_zero','combined_risk']) AS kind",
    "triples": """SELECT min_calibration, min_holdout, min_risk FROM (SELECT unnest([200, 400]) AS min_calibration), (SELECT unnest([20, 30]) AS min_holdout), (SELECT unnest([3, 5]) AS min_risk)""",
    "qual": """SELECT cand.*, kind, min_calibration, min_holdout, min_risk FROM cand, kinds, triples WHERE coalesce(nearest_outside,1e9)+1e-9>=5 AND calibration_land>=min_calibration AND holdout_land>=min_holdout AND
        (kind='clean' OR (kind='shadow' AND holdout_shadow>=min_risk) OR (kind='near_zero' AND holdout_near_zero>=min_risk)
         OR (kind='combined_risk' AND holdout_shadow>=min_risk AND holdout_near_zero>=min_risk))""",
    "cons0": """SELECT scene_id AS consumer, a, cents%37 AS r0, cents%43 AS c0, cents%37+1+cents%5 AS r1, cents%43+1+cents%4 AS c1, CASE a%3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS radius FROM scene""",
    "cons": "SELECT *, r0-radius AS ir0, c0-radius AS ic0, r1+radius AS ir1, c1+radius AS ic1 FROM cons0",
    "chg0": """SELECT consumer, radius, rmax, cmax, ir0, ic0, ir1, ic1, ir0>=0 AND ic0>=0 AND ir1<=rmax+1 AND ic1<=46 AS old_covers, ir0>=0 AND ic0>=0 AND ir1<=rmax+1 AND ic1<=cmax+1 AS new_covers,
        count(d.r) AS differing, max(d.delta) AS max_delta FROM cons CROSS JOIN ext LEFT JOIN (SELECT x.r, x.c, abs(y.z-x.z) AS delta FROM dem x JOIN demv2 y ON x.r=y.r AND x.c=y.c WHERE x.z IS DISTINCT FROM y.z) d
        ON d.r>=ir0 AND d.r<ir1 AND d.c>=ic0 AND d.c<ic1 GROUP BY 1,2,3,4,5,6,7,8,9,10""",
    "chg": """SELECT *, CASE WHEN NOT new_covers THEN 'scope_extension' WHEN NOT old_covers THEN 'scope_extension' WHEN differing=0 THEN 'artifact_only' ELSE 'value_change_in_scope' END AS change_class,
        NOT new_covers AS insufficient FROM chg0""",
    "inv": "SELECT 's'||(substr(consumer,10))::BIGINT::VARCHAR AS node FROM chg WHERE change_class<>'artifact_only'",
    "edges": """SELECT DISTINCT 's'||l_suppkey::VARCHAR AS src, 'o'||l_orderkey::VARCHAR AS dst FROM lineitem UNION ALL SELECT 'o'||o_orderkey::VARCHAR, 'c'||o_custkey::VARCHAR FROM orders
        UNION ALL SELECT 'c'||c_custkey::VARCHAR, 'n'||c_nationkey::VARCHAR FROM customer""",
    "d1": "SELECT dst AS node, min(src||'>'||dst) AS path FROM edges JOIN inv ON src=inv.node GROUP BY dst",
    "d2": "SELECT dst AS node, min(path||'>'||dst) AS path FROM edges JOIN d1 ON src=d1.node GROUP BY dst",
    "d3": "SELECT dst AS node, min(path||'>'||dst) AS path FROM edges JOIN d2 ON src=d2.node GROUP BY dst",
    "desc1": "SELECT node, path, 1 AS depth FROM d1 UNION ALL SELECT node, path, 2 FROM d2 UNION ALL SELECT node, path, 3 FROM d3",
    "nodes": "SELECT src AS node FROM edges UNION SELECT dst FROM edges",
    "marks": """SELECT n.node, CASE WHEN inv.node IS NOT NULL THEN 'invalidated' WHEN desc1.node IS NOT NULL THEN 'quarantined' ELSE 'valid' END AS mark,
        CASE WHEN inv.node IS NOT NULL THEN n.node ELSE desc1.path END AS path FROM nodes n LEFT JOIN inv ON n.node=inv.node LEFT JOIN desc1 ON n.node=desc1.node""",
}
